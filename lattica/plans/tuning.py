"""Selection over declared grids and readout arms, from shared sums of all folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..operators import reservoir, selection, windows
from . import register, sql_cte
from .sensor import DRAW, FEATURES, FOLDS, FRAME, LENGTH, ORDER, folds, frame

query = register("tuning")
PENALTIES = (0.1, 100.0, 10_000.0, 1_000_000.0)
ARM_PENALTY = 10.0


def _solved(n: int, a, b) -> list[str]:
    """Cramer's rule for up to three unknowns; a(i, j) and b(i) are SQL terms."""
    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        minor = lambda j: det([[r[k] for k in range(3) if k != j] for r in m[1:]])
        return f"({m[0][0]} * {minor(0)} - {m[0][1]} * {minor(1)} + {m[0][2]} * {minor(2)})"

    whole = [[a(i, j) for j in range(n)] for i in range(n)]
    replaced = lambda k: [[b(i) if j == k else whole[i][j] for j in range(n)] for i in range(n)]
    return [f"{det(replaced(k))} / {det(whole)}" for k in range(n)]


def _fit_sql(source: str, columns: list[str], target: str, penalty: str, extra: str = "") -> str:
    """fold_id, w0, w1, ...: ridge weights of columns and a bias over the training rows of each fold."""
    terms = [*columns, "1.0"]
    n = len(terms)
    sums = [f"sum({terms[i]} * {terms[j]}) AS a{i}{j}" for i in range(n) for j in range(i, n)] + [f"sum({terms[i]} * {target}) AS b{i}" for i in range(n)]
    a = lambda i, j: f"(a{min(i, j)}{max(i, j)}" + (f" + {penalty})" if i == j else ")")
    w = ", ".join(f"{e} AS w{k}" for k, e in enumerate(_solved(n, a, lambda i: f"b{i}")))
    return f"SELECT fold_id{extra}, {w} FROM (SELECT fold_id, {', '.join(sums)} FROM {source} WHERE split = 'train' GROUP BY fold_id) s"


def tuned_rows(spark, sf_dir):
    """Rows of the frame by fold, with the features s2 and s3."""
    f = frame(spark, sf_dir).join(folds(spark, sf_dir), "specimen_id")
    return f.select("fold_id", "split", "event_id", "s1", "freshness_class", F.array("s2", "s3").alias("f"), F.array("s2").alias("x"), F.array("s3").alias("h"))


@query(sql_cte(FRAME, FOLDS, "r AS (SELECT fold_id, split, s1, s2, s3 FROM frame JOIN folds USING (specimen_id))", f"p AS (SELECT unnest({list(PENALTIES)})::DOUBLE AS penalty)",
    f"w AS ({_fit_sql('r', ['s2', 's3'], 's1', 'penalty', ', penalty')}, p)",
    "v AS (SELECT fold_id, penalty, -avg(abs(w0 * s2 + w1 * s3 + w2 - s1)) AS score FROM r JOIN w USING (fold_id) WHERE split = 'val' GROUP BY ALL)",
    f"SELECT fold_id, penalty AS ridge_lambda, round(score, 6) AS score, {len(PENALTIES)} AS n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, penalty) AS k FROM v) WHERE k = 1"))
def grid_selection(spark, sf_dir):
    """The penalty of each fold with the least validation error, among the declared ones."""
    grid = selection.DeclaredGrid({"ridge_lambda": PENALTIES})
    best = selection.select_penalty(tuned_rows(spark, sf_dir), ["fold_id"], "f", "s1", grid)
    return best.withColumn("score", F.round("score", 6))


@query()
def reservoir_selection(spark, sf_dir):
    """Spectral radius and penalty of a reservoir, by validation macro F1 in every fold: all states come from one pass."""
    radii, penalties = (0.5, 0.9, 1.1), (0.001, 0.1, 10.0)
    grid = selection.DeclaredGrid({"spectral_scaling": radii, "ridge_lambda": penalties}, frozenset({"spectral_scaling"}))
    f, d = frame(spark, sf_dir), folds(spark, sf_dir)
    w = windows.sliding_windows(f, FEATURES, LENGTH, 4, order=ORDER).join(d, "specimen_id")
    w = windows.scaled_windows(w, windows.fold_scalers(f, d, FEATURES), FEATURES, ["fold_id"])
    family = {str(r): reservoir.random_reservoir(len(FEATURES), 1, reservoir_size=40, spectral_radius=r, washout=0) for r in radii}
    states = reservoir.window_states_of(w.where("split <> 'test'"), family, ["fold_id", "split", "label"])
    states = states.withColumn("spectral_scaling", F.col("control").cast("double")).drop("control")
    best = selection.select_penalty(states, ["fold_id"], "state", "label", grid, control="spectral_scaling", n_classes=4)
    return best.withColumn("score", F.round("score", 6))


def _arm_sql(arm: str, columns: list[str]) -> str:
    value = " + ".join(f"w{k} * {c}" for k, c in enumerate([*columns, "1.0"]))
    return f"SELECT fold_id, '{arm}' AS arm, count(*) AS n, round(-avg(abs({value} - s1)), 6) AS score FROM r JOIN ({_fit_sql('r', columns, 's1', str(ARM_PENALTY))}) w USING (fold_id) WHERE split = 'val' GROUP BY fold_id"


@query(sql_cte(FRAME, FOLDS,
    f"p AS (SELECT fold_id, split, event_id, s1, s2, s3, row_number() OVER (PARTITION BY fold_id, split ORDER BY event_id) AS k, row_number() OVER (PARTITION BY fold_id, split ORDER BY {DRAW.format(repr('arm|1|') + ' || event_id')}, event_id) AS d FROM frame JOIN folds USING (specimen_id))",
    "r AS (SELECT a.fold_id, a.split, a.s1, a.s2, a.s3, b.s3 AS hs FROM p a JOIN p b ON a.fold_id = b.fold_id AND a.split = b.split AND a.k = b.d)",
    " UNION ALL ".join(_arm_sql(*a) for a in (("X", ["s2"]), ("H", ["s3"]), ("X+H", ["s2", "s3"]), ("X+shuffled H", ["s2", "hs"]), ("zero H", ["s2"])))))
def readout_arms(spark, sf_dir):
    """What readouts lose without states: five arms a fold from one pass; s3 stands for the states."""
    rows = tuned_rows(spark, sf_dir)
    mixed = selection.shuffled_states(rows, ["fold_id", "split"], ["event_id"], draw("arm", 1, F.col("event_id")))
    return selection.readout_arms(mixed, ["fold_id"], "x", "h", "s1", ARM_PENALTY).withColumn("score", F.round("score", 6))
