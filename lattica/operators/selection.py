"""Selection over a declared grid, and readout arms, in one job each: all points of all folds come from shared sums."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .metrics import classification
from .models import CLASSIFICATION, first_best
from .ordering import with_position
from .reservoir import ridge_paths

#: Weights of all candidates that are sent to the tasks together, at most (doubles).
MAX_WEIGHTS = 32_000_000


class OutOfGridError(ValueError):
    """A value that the declared grid doesn't have."""


@dataclass(frozen=True)
class DeclaredGrid:
    """Candidates of each knob, in the order in which they are declared; `shared` knobs may be pinned for all models."""

    candidates: Mapping[str, Sequence[Any]]
    shared: frozenset[str] = field(default_factory=frozenset)

    def check(self, name: str, value: Any) -> None:
        """A declared knob takes declared values only; numbers are compared as numbers, and true is not 1."""
        if name not in self.candidates:
            return
        same = lambda c: type(c) is type(value) and c == value or not isinstance(c, (bool, str)) and not isinstance(value, (bool, str)) and c == value
        if not any(map(same, self.candidates[name])):
            raise OutOfGridError(f"{name} = {value!r} is not among the declared {list(self.candidates[name])}")

    def points(self, pinned: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
        """Every combination in declared order, the last knob fastest; pinned knobs keep their value."""
        pinned = dict(pinned or {})
        for name, value in pinned.items():
            if name not in self.shared:
                raise ValueError(f"{name} is not shared between models, so it can't be pinned")
            if name not in self.candidates:
                raise OutOfGridError(f"{name} is pinned but not declared")
            self.check(name, value)
        values = [[pinned[name]] if name in pinned else list(c) for name, c in self.candidates.items()]
        if not all(values):
            raise ValueError("a knob has no candidates")
        return [dict(zip(self.candidates, v, strict=True)) for v in itertools.product(*values)]


def candidate_outputs(rows: DataFrame, by: Sequence[str], features: str, weights: dict[tuple, np.ndarray], n_classes: int | None, keep: Sequence[str]) -> DataFrame:
    """keep, place, predicted: what each candidate of a row's group says; weights: (candidates, features + 1, outputs)."""
    if sum(w.size for w in weights.values()) > MAX_WEIGHTS:
        raise ValueError(f"the candidates have more than {MAX_WEIGHTS} weights together")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(list(by), sort=False):
                w = weights.get(key)
                if w is None:
                    continue
                h = np.column_stack([np.vstack(part["_h"].to_numpy()), np.ones(len(part))])
                out = np.einsum("ij,kjo->iko", h, w)
                said = out.argmax(2).astype(float) if n_classes else out[:, :, 0]
                yield part[list(keep)].assign(said=list(said))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    read = list(dict.fromkeys([*keep, *by]))
    done = rows.select(*read, F.col(features).alias("_h")).mapInPandas(run, f"{schema}, said array<double>")
    return done.select(*keep, F.posexplode("said").alias("place", "predicted"))


def _scores(done: DataFrame, by: Sequence[str], target: str, n_classes: int | None) -> DataFrame:
    """by, place, score: macro F1 over declared classes, or minus the mean absolute error."""
    if n_classes:
        truth = done.select(*by, "place", F.col(target).cast("int").alias("truth"), F.col("predicted").cast("int").alias("predicted"))
        return classification(truth, n_classes, [*by, "place"]).select(*by, "place", F.col("macro_f1").alias("score"))
    return done.groupBy(*by, "place").agg((-F.avg(F.abs(F.col("predicted") - F.col(target)))).alias("score"))


def _stacked(solved: DataFrame, by: Sequence[str], order: Sequence[tuple[str, float]], outputs: int) -> dict[tuple, np.ndarray]:
    at, held = {o: i for i, o in enumerate(order)}, {}
    for r in solved.collect():
        held.setdefault(tuple(r[c] for c in by), [None] * len(order))[at[r["arm"], r["penalty"]]] = np.array(r["weights"]).reshape(-1, outputs)
    return {k: np.stack(v) for k, v in held.items()}


def select_penalty(rows: DataFrame, by: Sequence[str], features: str, target: str, grid: DeclaredGrid, knob: str = "ridge_lambda", control: str | None = None, n_classes: int | None = None, pinned: Mapping[str, Any] | None = None) -> DataFrame:
    """by, (control,) knob, score, n_candidates: the best point of each group on its rows of split `val`, fitted on `train`.

    One Gram matrix for each group and value of `control` (a column that tells variants of the features apart, declared
    in the grid) gives the weights of all penalties; one pass over the validation rows scores them all.  The first
    declared point wins ties.  The test split isn't read.  A group without validation rows is an error."""
    points = grid.points(pinned)
    order = [("", float(p[knob])) for p in points if control is None or p[control] == points[0][control]]
    groups = [*by, *([control] if control else [])]
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    if control:
        used = [p[control] for p in points]
        train, val = train.where(F.col(control).isin(used)), val.where(F.col(control).isin(used))
    weights = _stacked(ridge_paths(train, groups, features, target, [p for _, p in order], n_classes), groups, order, n_classes or 1)
    done = candidate_outputs(val, groups, features, weights, n_classes, [*groups, target])
    scores = materialise(_scores(done, groups, target, n_classes), "selection-scores")
    scored = {tuple(r) for r in scores.select(*by).distinct().collect()}
    idle = sorted({key[: len(by)] for key in weights} - scored)[:5]
    if idle:
        raise ValueError(f"no validation rows in {idle}")
    named = F.element_at(F.array(*[F.lit(p) for _, p in order]), F.col("place") + 1)
    first = F.array_position(F.array(*[F.lit(c) for c in dict.fromkeys(p[control] for p in points)]), F.col(control)) if control else F.lit(1)
    ranked = scores.withColumn("_point", (first - 1) * len(order) + F.col("place")).withColumn(knob, named)
    best = first_best(ranked, list(by), "score", "_point")
    return best.select(*groups, knob, "score", F.lit(len(points)).alias("n_candidates"))


def shuffled_states(rows: DataFrame, within: Sequence[str], order: Sequence[str], draw, state: str = "h", name: str = "h_shuffled") -> DataFrame:
    """rows with the state of another row of its group, by a permutation of each group: the row at a place in `order`
    gets the state at that place in the order of `draw` (a column; ties by `order`).  No task sorts a group."""
    rows = materialise(rows.withColumn("_draw", draw), "arms-rows")
    placed = with_position(rows, [*within, *order], "_at").drop("_draw")
    dealt = with_position(rows.select(*within, *order, "_draw", F.col(state).alias(name)), [*within, "_draw", *order], "_at").select("_at", name)
    return placed.join(dealt, "_at").drop("_at")


def readout_arms(rows: DataFrame, by: Sequence[str], x: str, h: str, target: str, penalty: float, n_classes: int | None = None, shuffled: str = "h_shuffled") -> DataFrame:
    """by, arm, n, score: readouts of the input X alone, of the states H alone, of both, of X with shuffled states and of X
    with zero states; fitted on `train`, scored on `val`.

    All arms are blocks of one Gram matrix of (x, h, shuffled h), so each group's rows are summed once and its validation
    rows are read once."""
    one = rows.select(F.size(x).alias("x"), F.size(h).alias("h")).first()
    if one is None:
        raise ValueError("there are no rows")
    nx, nh = one["x"], one["h"]
    arms = {"X": list(range(nx)), "H": list(range(nx, nx + nh)), "X+H": list(range(nx + nh)), "X+shuffled H": [*range(nx), *range(nx + nh, nx + 2 * nh)], "zero H": list(range(nx))}
    every = rows.withColumn("_all", F.concat(x, h, shuffled))
    order = [(a, float(penalty)) for a in arms]
    solved = ridge_paths(every.where("split = 'train'"), list(by), "_all", target, [penalty], n_classes, arms)
    done = candidate_outputs(every.where("split = 'val'"), by, "_all", _stacked(solved, by, order, n_classes or 1), n_classes, [*by, target])
    n = done.groupBy(*by, "place").agg(F.count("*").alias("n"))
    scores = _scores(done, by, target, n_classes).join(n, [*by, "place"])
    return scores.select(*by, F.element_at(F.array(*[F.lit(a) for a in arms]), F.col("place") + 1).alias("arm"), "n", "score")


__all__ = ["CLASSIFICATION", "DeclaredGrid", "OutOfGridError", "candidate_outputs", "readout_arms", "select_penalty", "shuffled_states"]
