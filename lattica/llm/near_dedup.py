"""MinHash near-dedup (operator 6) by min-max hashing.

Texts with equal shingle sets are one class, of which the smallest id stands for all.  For each class
both the minimum and the maximum under each permutation are kept, which halves the hash evaluations of
an equally long signature; groups of its values are band keys.  Classes that share a band key are
candidates, and only pairs whose full sets meet the threshold are links.

A bucket (the classes with one band key) is never expanded into all pairs.  First each member is
compared with the bucket's hub, the member that shares most keys with others: of copies with edits of
their own, that is the one nearest to the original.  Where a bucket then still holds several components,
its members' links across components are found by an exact prefix filter: shingles are ordered from rare
to frequent, and two sets that meet the threshold must share one of their first few.  Edited copies
begin with shingles of their own, so members that can't be linked generate no pairs, and a shingle that only one
component begins with is left out before pairs are made.

Defined results: a null or empty text has an empty set and is linked with nothing.  A text with fewer
words than a shingle has one shingle, all its words.  Repeated rows get equal results.  Rows with one
id and different texts count as linked.  A row without an id is its own group (component null, kept).
An empty table gives no rows.  Other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import weak_components
from .common import id_text, materialise, remembered, slices

#: Chance that banding misses a pair at the threshold; values in a signature, at most.
MISS, MAX_VALUES = 1e-6, 128
#: Candidate ids are broadcast to the text scan up to so many, joined by shuffle beyond.
BROADCAST_IDS = 500_000
MEMORY_WORDS = 100_000
_SEED = 20250117


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _memory() -> dict:
    return remembered("near_dedup words", _Words)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, k: int, memory: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters, and space and 9 to 13
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, n)
    if n < k:
        h, n = np.concatenate([h, np.zeros(k - n, np.uint64)]), k
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : n - k + 1 + i] * np.uint64(2 * i + 3))
    return np.unique(out)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, values in a band) that miss a pair at the threshold with a chance of MISS at most."""
    t, best = percent / 100, None
    for r in range(2, 9):
        b = math.ceil(math.log(MISS) / math.log1p(-(t**r)))
        if b * r <= MAX_VALUES or best is None:
            best = (b + (b * r) % 2, r)
    return best


class MinMax:
    """Signatures of `bands * rows` values from half as many permutations."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**31, (n, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, (n, 1), dtype=np.uint32)
        self.c = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each band, from the least and the greatest value under each permutation."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low, high = np.full(len(self.a), 2**32 - 1, np.uint32), np.zeros(len(self.a), np.uint32)
        for i in range(0, len(x), 4096):
            v = x[i : i + 4096] * self.a + self.b
            low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
        values = np.concatenate([low, high]).astype(np.uint64).reshape(self.bands, self.rows)
        return _mix((values * self.c).sum(1) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its band keys (null for an empty set), a row for each row."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, memory = MinMax(bands, rows), _memory()
        for b in slices(batches):
            n, digest, keys = [], [], []
            for text in b.column(1):
                if len(memory) > MEMORY_WORDS:
                    memory.clear()
                s = shingle_set(text.as_py(), k, memory)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(hashing.band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted) of the documents whose id is a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory()
        for b in slices(batches):
            if len(memory) > MEMORY_WORDS:
                memory.clear()
            sets = [shingle_set(t.as_py(), k, memory).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    nodes = nodes.select(F.col("node").alias("doc_id"))
    few = nodes.count() <= BROADCAST_IDS
    texts = id_text(docs).join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
    return texts.mapInArrow(run, "node bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest id reachable) of every end of the links (a, b)."""
    return weak_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (a, b) between their components: only the components' labels are joined up
    again, not all nodes."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    ends = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(ends).select(F.col("node").alias("label"), F.col("label").alias("over"))
    every = labels.unionByName(over.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
    return every.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    good = both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    return pairs.select("a", "b").join(one, "b").join(two, "a").where(good).select("a", "b")


def sizes_fit(na: str, nb: str, percent: int):
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, b: each member (key, node, n, size of its bucket) with its bucket's hub, each pair once."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "node")
    hub = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("hub"))
    pairs = members.join(hub.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n")), "key").where((F.col("node") != F.col("hub")) & sizes_fit("n", "hub_n", percent))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b of different labels whose sets may meet the threshold: a superset of all that do.

    Of sets of x and y shingles, y' = ceil(percent (x + y) / (100 + percent)) must be shared; in any common order,
    some shared one is among the first x - y' + 1 of the one and the first y - y' + 1 of the other.  Shingles that
    only one set has come first, and only shift the others' places."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(common, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    n = sets.select("node", F.size("shingles").cast("bigint").alias("n"))
    ranked = ranked.join(n, "node").join(labels, "node")
    own = F.col("n") - F.size("shared")
    longest = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    first = F.slice("shared", 1, F.greatest(longest - own, F.lit(0)).cast("int"))
    places = ranked.select("node", "n", "label", own.alias("own"), F.posexplode(first).alias("pos", "s"))
    places = places.select("node", "n", "label", (F.col("own") + F.col("pos")).alias("pos"), "s.shingle")
    places = materialise(places, "near-places")
    apart = places.groupBy("shingle").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("shingle")
    places = materialise(places.join(materialise(apart, "near-apart"), "shingle", "left_semi"), "near-places")  # written, so that hot keys can be split
    one = places.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    two = places.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    shared = F.expr(f"((na + nb) * {percent} + {99 + percent}) div {100 + percent}")
    may = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes_fit("na", "nb", percent) & (F.col("pa") <= F.col("na") - shared) & (F.col("pb") <= F.col("nb") - shared)
    joined = one.join(two, (one["shingle"] == two["shingle"]) & may)
    return joined.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs."""
    sig = materialise(signatures(docs, shingle, percent), "near-signatures")
    classes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes, "near-classes")
    keys = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(keys.join(shared, "key"), "near-members")
    nodes = members.select("node").distinct()
    sets = materialise(shingle_sets(docs, nodes, shingle), "near-sets")
    if sets.count() > nodes.count():  # a row of its document is repeated
        sets = materialise(sets.dropDuplicates(["node"]), "near-sets")
    links = materialise(verify(star_pairs(members, percent), sets, percent), "near-links")
    labels = components(links)
    known = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = known.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
    rest = materialise(known.join(open_, "key").select("node", "label").distinct(), "near-open")
    more = verify(prefix_pairs(sets.join(rest.select("node"), "node", "left_semi"), rest, percent), sets, percent)
    labels = merged(labels, more)
    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    out = sig.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the document with the smallest id (one row of
    it, where its row is repeated), and every row without an id."""
    found = materialise(near_duplicates(docs, shingle, percent).select("doc_id", "kept"), "near-result")
    gone = found.where("NOT kept").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id IS NULL"))
