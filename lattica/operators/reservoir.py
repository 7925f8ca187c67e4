"""Recurrent state-space features over windows, linear readouts, ranks and graph controls.

A reservoir is a bounded matrix (MAX_NODES), so it travels to the tasks; windows stay distributed.  The
recurrence is numpy over Arrow batches, since no built-in function carries a state; everything that grows
with the windows (Gram matrices, metrics) is summed in partitions first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import induced

MAX_NODES = 4000
#: The reference defaults and gates that results must agree with.
DEFAULTS = {"reservoir_size": 200, "leak": 0.3, "gain": 1.0, "input_scale": 0.5, "ridge_lambda": 1.0e-3, "washout": 10, "state_pooling": "last", "spectral_radius": 0.9, "density": 0.05}
KRYLOV_K, KRYLOV_TOLERANCE = 16, 1e-10
A1_SCC_FRACTION_MIN, A1_ISOLATED_FRACTION_MAX, A1_MEAN_OUT_DEGREE_MIN = 0.90, 0.02, 2.0
A2_OVERLAP_MAX, A3_FACTOR, A4_MIN, A5_FACTOR = 0.20, 2.0, 0.20, 1.5
MEMORY_LAGS = (1, 4, 8, 16)


@dataclass(frozen=True)
class Reservoir:
    """Recurrent weights (n, n), input weights (n, channels) and bias (n)."""

    a: np.ndarray
    w_in: np.ndarray
    bias: np.ndarray
    leak: float = DEFAULTS["leak"]
    gain: float = DEFAULTS["gain"]
    washout: int = DEFAULTS["washout"]
    pooling: str = DEFAULTS["state_pooling"]

    def __post_init__(self) -> None:
        n = len(self.a)
        if n > MAX_NODES or self.a.shape != (n, n) or self.w_in.shape[0] != n or self.bias.shape != (n,):
            raise ValueError("shapes of a reservoir must agree, with at most MAX_NODES nodes")

    def states(self, x: np.ndarray) -> np.ndarray:
        """Pooled state of each window; x: (windows, steps, channels).  All windows of a batch advance together."""
        steps = x.shape[1]
        washout = min(self.washout, max(steps - 1, 0))
        driven = x @ self.w_in.T + self.bias
        h, total = np.zeros((len(x), len(self.a))), np.zeros((len(x), len(self.a)))
        for t in range(steps):
            h = (1 - self.leak) * h + self.leak * np.tanh(self.gain * (h @ self.a.T) + driven[:, t])
            if t >= washout:
                total += h
        return total / (steps - washout) if self.pooling == "mean" else h

    def trace(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States of one series (steps, channels) and the ratio of recurrent to input drive at each step."""
        h, out, ratio = np.zeros(len(self.a)), [], []
        for row in x:
            inner, outer = self.gain * (self.a @ h), self.w_in @ row
            ratio.append(np.linalg.norm(inner) / max(np.linalg.norm(outer), 1e-12))
            h = (1 - self.leak) * h + self.leak * np.tanh(inner + outer + self.bias)
            out.append(h)
        return np.array(out), np.array(ratio)


def spectral_radius(a: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(a)).max()) if len(a) else 0.0


def scaled(a: np.ndarray, target: float) -> np.ndarray:
    r = spectral_radius(a)
    return a * (target / r) if r > 1e-12 else a


def random_reservoir(channels: int, seed: int = 0, **params) -> Reservoir:
    """The plain echo-state network: a random sparse matrix at the wanted spectral radius."""
    p = {**DEFAULTS, **params}
    rng, n = np.random.default_rng(seed), p["reservoir_size"]
    a = np.where(rng.random((n, n)) < p["density"], rng.uniform(-1, 1, (n, n)), 0.0)
    w_in = rng.uniform(-1, 1, (n, channels)) * p["input_scale"]
    bias = rng.uniform(-p["input_scale"], p["input_scale"], n)
    return Reservoir(scaled(a, p["spectral_radius"]), w_in, bias, p["leak"], p["gain"], p["washout"], p["state_pooling"])


def from_edges(edges: DataFrame, nodes: DataFrame, channels: int, seed: int = 0, **params) -> Reservoir:
    """A reservoir on a graph's selected nodes; a selection that is too large is an error."""
    p = {**DEFAULTS, **params}
    ids = [r.id for r in nodes.select("id").distinct().orderBy("id").limit(MAX_NODES + 1).collect()]
    if len(ids) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    at = {k: i for i, k in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for r in induced(edges, nodes).toLocalIterator():
        a[at[r.dst], at[r.src]] = r.w
    rng = np.random.default_rng(seed)
    w_in = rng.uniform(-1, 1, (len(ids), channels)) * p["input_scale"]
    bias = rng.uniform(-p["input_scale"], p["input_scale"], len(ids))
    return Reservoir(scaled(a, p["spectral_radius"]), w_in, bias, p["leak"], p["gain"], p["washout"], p["state_pooling"])


def _windows_of(column: pa.Array) -> np.ndarray:
    """(windows, steps, channels) of a column of equally long windows."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), len(column[0]), -1)


def window_states_of(windows: DataFrame, reservoirs: dict[str, Reservoir], keep: list[str]) -> DataFrame:
    """keep, control, state: the pooled state of each window's x in each reservoir, from one pass over the windows."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.select(*keep).schema)
    sent = windows.sparkSession.sparkContext.broadcast(reservoirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _windows_of(b.column(len(keep)))
                for name, r in sent.value.items():
                    h = r.states(x)
                    states = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([name] * b.num_rows), states], [*keep, "control", "state"])

    return windows.select(*keep, "x").mapInArrow(run, f"{fields}, control string, state array<double>")


def window_states(windows: DataFrame, reservoir: Reservoir, keep: list[str]) -> DataFrame:
    """keep, state: the pooled state of each window's x."""
    return window_states_of(windows, {"": reservoir}, keep).drop("control")


#: Rows of a Gram matrix that travel together, and groups of partitions whose sums are added first.
GRAM_ROWS, GRAM_GROUPS = 64, 32
#: Rows that are mapped to features at once.
MAPPED_ROWS = 2000
Map = Callable[[np.ndarray], np.ndarray]


def gram_blocks(rows: DataFrame, by: list[str], features: str, target: str, n_classes: int | None = None, mapped: Map | None = None) -> DataFrame:
    """by, block, cells: H'H and H'Y, with a bias column, of each group of `by`, in blocks of GRAM_ROWS rows.

    Each partition's sums are cut into blocks, which the executors add up in two steps.  A task holds a matrix for each
    group that it meets.  mapped: what turns rows of features into those that count, in the task and never written."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(by) if by else [((), b)] if len(b) else []:
                size = MAPPED_ROWS if mapped else len(part)
                for some in (part.iloc[at : at + size] for at in range(0, len(part), size)):
                    h = np.vstack(some[features].to_numpy())
                    h = np.column_stack([mapped(h) if mapped else h, np.ones(len(h))])
                    y = some[target].to_numpy(np.float64)
                    y = np.eye(n_classes)[y.astype(int)] if n_classes else y[:, None]
                    here = np.hstack([h.T @ h, h.T @ y])
                    total[key] = total[key] + here if key in total else here
        group = TaskContext.get().partitionId() % GRAM_GROUPS
        for key, whole in total.items():
            for at in range(0, len(whole), GRAM_ROWS):
                yield pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "grp": [group], "block": [at], "cells": [whole[at : at + GRAM_ROWS].ravel()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        first = parts.iloc[[0]].copy()
        first["grp"] = np.int32(0)
        first["cells"] = [np.sum(np.vstack(parts["cells"].to_numpy()), axis=0)]
        return first

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema), "grp int, block int, cells array<double>"])
    parts = rows.select(*by, features, target).mapInPandas(sums, schema)
    for keys in ([*by, "grp", "block"], [*by, "block"]):
        parts = parts.groupBy(*keys).applyInPandas(add, schema)
    return parts.drop("grp")


def ridge_paths(rows: DataFrame, by: list[str], features: str, target: str, penalties: Sequence[float], n_classes: int | None = None, arms: dict[str, list[int]] | None = None, mapped: Map | None = None) -> DataFrame:
    """by, arm, penalty, weights: solutions of (H'H + penalty I) W = H'Y for each group, penalty and arm, solved on the executors.

    One Gram matrix serves all: an arm is the block of its features' rows and columns (and the bias), and one
    eigendecomposition of a block gives every penalty.  weights: rows of outputs for all features, 0 for those
    that an arm leaves out; directions of no variance get none (penalty 0)."""
    outputs = n_classes or 1
    given = [float(p) for p in penalties]

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        cells = np.concatenate(parts.sort_values("block")["cells"].to_list())
        n = round((np.sqrt(outputs**2 + 4 * len(cells)) - outputs) / 2)  # n rows of n + outputs cells
        whole, out = cells.reshape(n, n + outputs), []
        for arm, columns in (arms or {"": list(range(n - 1))}).items():
            own = [*columns, n - 1]
            block, right = whole[np.ix_(own, own)], whole[np.ix_(own, range(n, n + outputs))]
            values, axes = np.linalg.eigh(block)
            values = np.where(values > values.max() * len(own) * np.finfo(float).eps, values, 0.0)
            turned = axes.T @ right
            for p in given:
                w = np.zeros((n, outputs))
                if p > 0 and len(given) == 1:
                    w[own] = np.linalg.solve(block + p * np.eye(len(own)), right)
                else:
                    scale = np.divide(1.0, values + p, out=np.zeros_like(values), where=values + p > 0)
                    w[own] = axes @ (scale[:, None] * turned)
                out.append((arm, p, w.ravel()))
        keys = {c: [parts[c].iloc[0]] * len(out) for c in by}
        return pd.DataFrame({**keys, "arm": [o[0] for o in out], "penalty": [o[1] for o in out], "weights": [o[2] for o in out]})

    blocks = gram_blocks(rows, by, features, target, n_classes, mapped)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema), "arm string, penalty double, weights array<double>"])
    return blocks.groupBy(*by).applyInPandas(solve, schema) if by else blocks.groupBy(F.lit(0).alias("all")).applyInPandas(solve, schema)


def ridge_by(rows: DataFrame, by: list[str], features: str, target: str, penalty: float = DEFAULTS["ridge_lambda"], n_classes: int | None = None, mapped: Map | None = None) -> dict[tuple, np.ndarray]:
    """The weights of each group at one penalty; only these come to the driver."""
    found = ridge_paths(rows, by, features, target, [penalty], n_classes, mapped=mapped).collect()
    return {tuple(r[c] for c in by): np.array(r["weights"]).reshape(-1, n_classes or 1) for r in found}


def ridge(rows: DataFrame, features: str, target: str, penalty: float = DEFAULTS["ridge_lambda"], n_classes: int | None = None, mapped: Map | None = None) -> np.ndarray:
    """The same for all rows together."""
    return ridge_by(rows, [], features, target, penalty, n_classes, mapped)[()]


def read_out_by(rows: DataFrame, by: list[str], features: str, weights: dict[tuple, np.ndarray], name: str = "predicted") -> DataFrame:
    """The class of the greatest output of each row's group; null for a group without weights."""

    @F.pandas_udf("double")
    def out(h: pd.Series, *keys: pd.Series) -> pd.Series:
        done = pd.Series(np.nan, index=h.index)
        for key, at in pd.DataFrame(dict(enumerate(keys))).groupby(list(range(len(keys)))).groups.items():
            w = weights.get(key if isinstance(key, tuple) else (key,))
            if w is not None:
                done[at] = (np.column_stack([np.vstack(h[at].to_numpy()), np.ones(len(at))]) @ w).argmax(1)
        return done

    return rows.withColumn(name, F.nullif(out(features, *by), F.lit(float("nan"))))


def read_out(rows: DataFrame, features: str, weights: np.ndarray, name: str = "predicted", mapped: Map | None = None) -> DataFrame:
    """The estimate (one output) or the class of the greatest output."""

    @F.pandas_udf("double")
    def out(h: pd.Series) -> pd.Series:
        size = MAPPED_ROWS if mapped else max(1, len(h))
        parts = [np.vstack(h.to_numpy()[at : at + size]) for at in range(0, len(h), size)]
        y = np.vstack([np.column_stack([mapped(p) if mapped else p, np.ones(len(p))]) @ weights for p in parts])
        return pd.Series(y[:, 0] if y.shape[1] == 1 else y.argmax(1).astype(float))

    return rows.withColumn(name, out(features))


def participation_rank(states: np.ndarray) -> float:
    """(sum s)^2 / sum s^2 over singular values of centred states."""
    s = np.linalg.svd(states - states.mean(0), compute_uv=False)
    s = s[s > 1e-12]
    return float(s.sum() ** 2 / (s**2).sum()) if len(s) else 0.0


def krylov_rank(a: np.ndarray, b: np.ndarray, k: int = KRYLOV_K, tolerance: float = KRYLOV_TOLERANCE) -> float:
    """Effective rank of [B, AB, ..., A^k B] with an absolute tolerance (k + 1 blocks)."""
    blocks = [b]
    for _ in range(k):
        blocks.append(a @ blocks[-1])
    s = np.linalg.svd(np.hstack(blocks), compute_uv=False)
    s = s[s > tolerance]
    return float(s.sum() ** 2 / (s**2).sum()) if len(s) else 0.0


def controllability_rank(a: np.ndarray, b: np.ndarray, k: int = KRYLOV_K) -> float:
    """The same of k blocks, one fewer."""
    return krylov_rank(a, b, k - 1)


def henrici(a: np.ndarray) -> float:
    """Departure from normality."""
    f2 = float((a * a).sum())
    return float(np.sqrt(max(0.0, f2 - float((np.abs(np.linalg.eigvals(a)) ** 2).sum()))))


def spectrum(a: np.ndarray) -> dict[str, float]:
    s = np.linalg.svd(a, compute_uv=False)
    p = s / s.sum() if s.sum() > 0 else s
    p = p[p > 0]
    return {"stable_rank": float((s**2).sum() / s[0] ** 2) if len(s) and s[0] > 0 else 0.0, "participation": float(s.sum() ** 2 / (s**2).sum()) if (s**2).sum() > 0 else 0.0, "entropy_rank": float(np.exp(-(p * np.log(p)).sum()))}


def memory(states: np.ndarray, x: np.ndarray, washout: int = 0, lags=MEMORY_LAGS) -> float:
    """Greatest, over lags k, of the channels' mean |corr(mean state at t, input at t + k)|: the pairing looks ahead."""
    m, x = states[washout:].mean(1), x[washout:]
    best = 0.0
    for k in lags:
        if len(m) <= k + 2:
            continue
        r = [abs(np.corrcoef(m[:-k], x[k:, c])[0, 1]) for c in range(x.shape[1]) if m[:-k].std() > 0 and x[k:, c].std() > 0]
        best = max(best, float(np.mean(r)) if r else 0.0)
    return best


def lead_correlation(frame: DataFrame, by: list[str], order: list[str], state: str, inputs: list[str], lags=MEMORY_LAGS) -> DataFrame:
    """The same for a series in a table: by, lag, mean absolute correlation of state with inputs that many rows ahead."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = None
    for k in lags:
        ahead = frame.select(*by, state, *[F.lead(c, k).over(w).alias(c) for c in inputs])
        r = ahead.groupBy(*by).agg(*[F.abs(F.corr(state, c)).alias(c) for c in inputs])
        total = sum((F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in inputs), F.lit(0.0))
        one = r.select(*by, F.lit(k).alias("lag"), (total / len(inputs)).alias("mean_abs_corr"))
        out = one if out is None else out.unionByName(one)
    return out


def audit(a: np.ndarray, b: np.ndarray, strong_fraction: float, seed: int = 0, steps: int = 400) -> list[tuple[str, str, float | None, float]]:
    """(criterion, state, value, threshold) of A1 and A3 to A5.  Where A3 fails, A4 and A5 are not applicable."""
    n, din = b.shape
    adjacent = (a != 0).astype(float)
    off = adjacent - np.diag(np.diag(adjacent))
    isolated = float(((off.sum(0) + off.sum(1)) == 0).mean())
    degree = float(adjacent.sum() / n)
    a1 = strong_fraction >= A1_SCC_FRACTION_MIN and isolated <= A1_ISOLATED_FRACTION_MAX and degree >= A1_MEAN_OUT_DEGREE_MIN
    rank = krylov_rank(a, b)
    rows = [("A1", "PASS" if a1 else "FAIL", strong_fraction, A1_SCC_FRACTION_MIN), ("A3", "PASS" if rank >= A3_FACTOR * din else "FAIL", rank, A3_FACTOR * din)]
    if rank < A3_FACTOR * din:
        return [*rows, ("A4", "not_applicable", None, A4_MIN), ("A5", "not_applicable", None, A5_FACTOR * din)]
    rng = np.random.default_rng(seed)
    x = np.zeros((steps, din))
    for t in range(1, steps):
        x[t] = 0.8 * x[t - 1] + rng.normal(0, 0.6, din)
    driven, alone = Reservoir(a, b, np.zeros(n)), Reservoir(np.zeros_like(a), b, np.zeros(n))
    states, still = driven.trace(x)[0], alone.trace(x)[0]
    m, m0 = memory(states, x, 50), memory(still, x, 50)
    kept = (m - m0) / m if m > 0 else 0.0
    wide = participation_rank(states[50:])
    return [*rows, ("A4", "PASS" if kept >= A4_MIN else "FAIL", kept, A4_MIN), ("A5", "PASS" if wide >= A5_FACTOR * din else "FAIL", wide, A5_FACTOR * din)]


def rewired(src: np.ndarray, dst: np.ndarray, w: np.ndarray, swaps: int, seed: int = 0, keep_weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-edge swaps without self-loops or repeated edges; degrees are kept.  With keep_weights, partners have equal
    weights, so strengths and each source's weights are kept too; else all weights become 1."""
    rng = np.random.default_rng(seed)
    dst, taken = dst.copy(), set(zip(src.tolist(), dst.tolist(), strict=True))
    groups = [np.flatnonzero(w == v) for v in np.unique(w)] if keep_weights else [np.arange(len(src))]
    groups = [g for g in groups if len(g) > 1]
    share = np.array([len(g) for g in groups], float)
    for _ in range(swaps if len(groups) else 0):
        g = groups[rng.choice(len(groups), p=share / share.sum())]
        i, j = rng.choice(g, 2, replace=False)
        a, b = (int(src[i]), int(dst[j])), (int(src[j]), int(dst[i]))
        if a[0] == a[1] or b[0] == b[1] or a in taken or b in taken or a == b:
            continue
        taken -= {(int(src[i]), int(dst[i])), (int(src[j]), int(dst[j]))}
        taken |= {a, b}
        dst[i], dst[j] = dst[j], dst[i]
    return src, dst, w if keep_weights else np.ones_like(w)


def random_graph(n: int, m: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """m distinct cells without self-loops."""
    rng = np.random.default_rng(seed)
    cells = rng.choice(n * (n - 1), min(m, n * (n - 1)), replace=False)
    src, rest = cells // (n - 1), cells % (n - 1)
    return src, rest + (rest >= src)


def small_world(n: int, k: int, p: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A ring of k neighbours on each side whose ends move with probability p; collisions lose edges."""
    rng, pairs = np.random.default_rng(seed), set()
    for i in range(n):
        for d in range(1, k + 1):
            j = (i + d) % n
            if rng.random() < p:
                j = int(rng.integers(n))
            if j != i:
                pairs.add((i, j))
    s, d = zip(*sorted(pairs), strict=True)
    return np.array(s), np.array(d)


def ring_capacity(n: int, tau_max: int, seed: int = 0, steps: int = 600) -> float:
    """Delay memory capacity of a ring: summed R2 of ridge readouts of delayed inputs."""
    rng = np.random.default_rng(seed)
    u = rng.uniform(-1, 1, (steps, 1))
    ring = np.roll(np.eye(n), 1, axis=0) * 0.9
    states = Reservoir(ring, rng.uniform(-1, 1, (n, 1)) * 0.5, np.zeros(n), leak=1.0).trace(u)[0]
    total = 0.0
    for tau in range(1, tau_max + 1):
        h, y = states[50 + tau :], u[50 : steps - tau, 0]
        w = np.linalg.solve(h.T @ h + 1e-6 * np.eye(n), h.T @ y)
        total += max(0.0, 1 - float(((y - h @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()))
    return total


def narma(steps: int, order: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Input and target of the nonlinear autoregressive moving-average task."""
    rng = np.random.default_rng(seed)
    u, y = rng.uniform(0, 0.5, steps), np.zeros(steps)
    for t in range(order, steps):
        y[t] = np.clip(0.3 * y[t - 1] + 0.05 * y[t - 1] * y[t - order : t].sum() + 1.5 * u[t - order] * u[t - 1] + 0.1, -10, 10)
    return u, y


def delayed_xor(steps: int, delay: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    u = np.random.default_rng(seed).integers(0, 2, steps)
    return u, np.concatenate([np.zeros(delay, int), u[delay:] ^ u[:-delay]])
