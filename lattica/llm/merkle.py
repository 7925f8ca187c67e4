"""Merkle manifest of a data set (operator 12): a tree of digests of fan-out 3 for each source, one over the sources.

A row's leaf is the SHA-256 of its fields, each as `-` (null) or its UTF-8 byte count, `:` and its value.  Leaves are
range-sorted by source and id into parts; the counts of a source's rows in its parts tell where in the
source's tree each part's leaves begin.  Each part builds the subtrees that lie wholly in it, at whatever level, and hands on
its ragged nodes, whose parents have children in other parts: four a level at most.  These are shuffled by the
coordinate of an ancestor some levels above, which finishes the levels between, and so on up to the source's subroot.
Subroots by source are the leaves of a tree that is built in the same way.  Then each part gets the few finished
nodes beside its own and folds every leaf's siblings up to the root.

No group is gathered: a task holds a part (`PART_ROWS` digests), or the nodes of a subtree of `LEVELS` levels.

Defined results: rows of one source and id are ordered by their leaf; equal rows have equal leaves, of which each has a
place and a proof of its own.  A null source is a source of its own, before all others; null ids come first in theirs and are not
tampered with.  Empty and very long texts are values like others.  Columns besides the five named are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .parts import in_parts, segments

FAN = 3
#: Leaves in a part, about; levels that one round finishes, so that a task has at most 3^6 lowest nodes of a subtree.
PART_ROWS, LEVELS = 50_000, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it goes into a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row's five fields, some of them changed."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def digest(nodes: Iterable[str]) -> str:
    return sha256("".join(nodes).encode("ascii")).hexdigest()


def depth_of(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


@dataclass
class Level:
    """Consecutive nodes of one level that a part has: from place `low`, of `n` in the whole tree."""

    low: int
    nodes: list[str]
    n: int

    @property
    def high(self) -> int:
        return self.low + len(self.nodes)

    def whole(self) -> tuple[int, int]:
        """The places, from and below, of the parents whose children are all here."""
        return -(-self.low // FAN), -(-self.high // FAN) if self.high == self.n else self.high // FAN


def local_levels(low: int, leaves: list[str], n: int) -> list[Level]:
    """The levels that a run of leaves builds alone, from the leaves up."""
    levels = [Level(low, leaves, n)]
    while levels[-1].n > 1:
        last = levels[-1]
        start, end = last.whole()
        if end <= start:
            break
        at = [FAN * p - last.low for p in range(start, end)]
        levels.append(Level(start, [digest(last.nodes[i : i + FAN]) for i in at], -(-last.n // FAN)))
    return levels


def ragged(levels: list[Level]) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the nodes whose parent this part can't build, and of a root."""
    for k, level in enumerate(levels):
        start, end = level.whole()
        if level.n == 1 or end <= start:
            keep = range(level.low, level.high)
        else:
            keep = [*range(level.low, FAN * start), *range(FAN * end, level.high)]
        for i in keep:
            yield k, i, level.nodes[i - level.low]


def finished(nodes: dict[tuple[int, int], str], n: int, top: int) -> dict[tuple[int, int], str]:
    """The parents of nodes (level, place) up to level `top`; every child of such a parent is among them or their parents."""
    made: dict[tuple[int, int], str] = {}
    for level in range(min(k for k, _ in nodes), top):
        size = n
        for _ in range(level):
            size = -(-size // FAN)
        here = {i: d for (k, i), d in [*nodes.items(), *made.items()] if k == level}
        for p in sorted({i // FAN for i in here}):
            made[level + 1, p] = digest(here[i] for i in range(FAN * p, min(FAN * p + FAN, size)))
    return made


def path_of(place: int, levels: list[Level], upper: dict[tuple[int, int], str], n: int) -> list[tuple[str, str]]:
    """The siblings before and after a leaf's ancestor, level by level."""
    out, size = [], n
    for k in range(depth_of(n)):
        start = place - place % FAN
        level = levels[k] if k < len(levels) else None
        run = [level.nodes[i - level.low] if level and level.low <= i < level.high else upper[k, i] for i in range(start, min(start + FAN, size))]
        own = place - start
        out.append(("".join(run[:own]), "".join(run[own + 1 :])))
        place, size = place // FAN, -(-size // FAN)
    return out


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest((before, node, after))
    return node


NODE = "part int, grp string, level int, place bigint, digest string, n bigint"


def _runs(table: pa.Table, parts: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    """The segments of a part with their rows, in order."""
    rows, at = table.sort_by("pos"), 0
    for s in parts.sort_by("first").to_pylist():
        yield s, rows.slice(at, s["m"])
        at += s["m"]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


@dataclass
class Forest:
    """Trees over groups of leaves: written leaves (grp, leaf, part, pos, ...), segments, and the nodes that no part has alone."""

    leaves: DataFrame
    parts: DataFrame
    nodes: DataFrame

    def roots(self) -> DataFrame:
        """grp, digest of each group's root."""
        return self.nodes.where(f"level = {_DEPTH}").select("grp", "digest")

    def beside(self) -> DataFrame:
        """part, level, place, digest, grp: the nodes that each part needs besides its own: children of the ancestors
        of its segments' first and last leaves."""
        spread = self.parts.where("m < n").select("part", "grp", "before", "m", F.explode(F.expr(f"sequence(0, {_DEPTH} - 1)")).alias("level"))
        parent = lambda place: f"({place} div cast(power({FAN}, level + 1) as bigint))"
        ends = spread.select("part", "grp", "level", F.explode(F.array_distinct(F.array(F.expr(parent("before")), F.expr(parent("(before + m - 1)"))))).alias("parent"))
        wanted = ends.select("part", "grp", "level", F.explode(F.expr(f"sequence(parent * {FAN}, parent * {FAN} + {FAN - 1})")).alias("place"))
        have = self.nodes.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("place").alias("p"), "digest")
        found = wanted.join(have, wanted["grp"].eqNullSafe(have["g"]) & (wanted["level"] == have["l"]) & (wanted["place"] == have["p"]))
        return found.select("part", "grp", "level", "place", "digest")


#: Levels above a group's n leaves: ceil(log3 n), in whole numbers.
_DEPTH = "aggregate(sequence(1, 40), 0, (d, i) -> if(cast(power(3, i - 1) as decimal(38, 0)) < n, i, d))"


def plant(leaves: DataFrame, order: list[str], name: str, rows: int = PART_ROWS, levels: int = LEVELS) -> Forest:
    """The forest of a written table with columns grp and leaf; leaves are ordered by grp and `order`."""
    ordered = in_parts(leaves, ["grp", *order], rows, f"{name}-leaves")
    parts = segments(ordered, "grp", f"{name}-segments")

    def build(key: tuple, table: pa.Table, segs: pa.Table) -> pa.Table:
        out = [(s["part"], s["grp"], *node, s["n"]) for s, run in _runs(table, segs) for node in ragged(local_levels(s["before"], run["leaf"].to_pylist(), s["n"]))]
        return _table(out, NODE)

    narrow = ordered.select("part", "pos", "leaf")
    nodes = materialise(narrow.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(build, NODE), f"{name}-nodes")

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        n, top = table["n"][0].as_py(), min(table["top"][0].as_py(), depth_of(table["n"][0].as_py()))
        have = {(r["level"], r["place"]): r["digest"] for r in table.to_pylist()}
        grp = table["grp"][0].as_py()
        return _table([(None, grp, k, i, d, n) for (k, i), d in finished(have, n, top).items()], NODE)

    deepest = nodes.where(f"level < {_DEPTH}").agg(F.max(F.expr(_DEPTH))).first()[0] or 0
    for top in range(levels, deepest + levels, levels):
        low = nodes.where(f"level < {_DEPTH} AND level < {top} AND level >= {top - levels}")
        over = low.withColumn("top", F.lit(top)).withColumn("over", F.expr(f"place div cast(power({FAN}, {top} - level) as bigint)"))
        made = materialise(over.groupBy("grp", "over").applyInArrow(finish, NODE), f"{name}-upper")
        nodes = nodes.unionByName(made)
    return Forest(ordered, parts, nodes)


def paths(forest: Forest, id_cols: str, out: str, row, extra: DataFrame | None = None) -> DataFrame:
    """The rows that `row(rows of a segment as dicts, paths, segment)` makes; id_cols: what it reads of each leaf.

    extra: columns of each segment by (part, grp), besides its own."""
    beside = forest.beside()
    segs = forest.parts if extra is None else extra
    blank = [F.lit(None).cast(t).alias(c) for c, t in beside.dtypes if c not in ("part", "grp")]
    empty = [F.lit(None).cast(t).alias(c) for c, t in segs.dtypes if c not in ("part", "grp")]
    known = segs.select("*", *blank).unionByName(beside.select("*", *empty))

    def prove(key: tuple, table: pa.Table, more: pa.Table) -> pa.Table:
        upper: dict = {}
        for r in more.filter(pa.compute.is_valid(more["level"])).select(["grp", "level", "place", "digest"]).to_pylist():
            upper.setdefault(r["grp"], {})[r["level"], r["place"]] = r["digest"]
        rows: list[tuple] = []
        for s, run in _runs(table, more.filter(pa.compute.is_null(more["level"]))):
            levels = local_levels(s["before"], run["leaf"].to_pylist(), s["n"])
            above = upper.get(s["grp"], {})
            rows += [row(r, path_of(s["before"] + i, levels, above, s["n"]), s) for i, r in enumerate(run.to_pylist())]
        return _table(rows, out)

    leaves = forest.leaves.select("part", "pos", "leaf", *id_cols.split())
    return leaves.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(prove, out)


def manifest(docs: DataFrame, altered: Column | None = None, rows: int = PART_ROWS, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of docs.

    altered: the text that a check finds in place of the original, where it isn't null; the leaf made from it is
    folded with the siblings of the manifest."""
    d = docs.select(*[F.col(c).cast("bigint" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS], (F.lit(None) if altered is None else altered).cast("string").alias("_altered"))
    changed = F.when(F.col("_altered").isNotNull(), leaf(text=F.col("_altered")))
    leaves = materialise(d.select(F.col("source").alias("grp"), "doc_id", leaf().alias("leaf"), changed.alias("found")), "merkle-leaves")
    forest = plant(leaves, ["doc_id", "leaf"], "merkle", rows, levels)

    subroots = materialise(forest.roots().select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("digest").alias("leaf")), "merkle-subroots")
    top = plant(subroots, ["source"], "merkle-top", rows, levels)
    whole = "source string, subroot string, root string, befores array<string>, afters array<string>"

    def of_source(r: dict, path: list, s: dict) -> tuple:
        return r["source"], r["leaf"], fold(r["leaf"], path), [b for b, _ in path], [a for _, a in path]

    over = materialise(paths(top, "source", whole, of_source), "merkle-paths")
    known = forest.parts.join(over, forest.parts["grp"].eqNullSafe(over["source"])).drop("source")
    result = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def of_row(r: dict, path: list, s: dict) -> tuple:
        path = [*path, *zip(s["befores"], s["afters"], strict=True)]
        folded = fold(r["found"] or r["leaf"], path)
        return r["doc_id"], r["leaf"], s["subroot"], s["root"], digest(b + a for b, a in path), folded, folded == s["root"]

    return paths(forest, "doc_id found", result, of_row, known)
