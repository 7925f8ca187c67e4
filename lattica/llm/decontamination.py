"""Benchmark decontamination (operator 1): SimHash of item-sized windows.

Words are runs of letters, digits and underscores in lower case; shingles are five words.  A document's
windows of as many words as a benchmark item get a 64-bit SimHash of their weighted shingles.  A
multi-index over blocks of the items' fingerprints yields every item within RADIUS of a window's, and
the exact weighted-shingle similarity of window and item decides.

Windows whose shingles occurring anywhere in the benchmark weigh less than the threshold demands
can't be similar to any item; they are left out before fingerprints are taken, without loss.

A shingle weighs 1 + ln((1 + items) / (1 + items with it)) for each time that it occurs; both are counted over all
items of the benchmark, however many passes match them.  A shingle of no item weighs as one of a single item, so only
those of several items are counted apart.

Defined results: null and empty texts and items match nothing.  An item with fewer words than a shingle has
one shingle, all its words; a document with fewer words than an item is one window.  Repeated rows of
documents match alike; repeated items are matched each.  Null ids are kept as null.  Without items
nothing matches.  Input columns other than the id and the text are not read, and are passed through by
`keep_clean`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, slices

SHINGLE, THRESHOLD = 5, 0.8
#: Of windows that just meet the threshold, fingerprints differ in 9.6 bits on average, and in more than RADIUS in less than
#: one case of a thousand (none of 1,090 pairs of similarity 0.80 to 0.82).  Four blocks of 16 bits let 14 % of random pairs pass.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
NEAR = RADIUS // BLOCKS  # bits that the best block differs in at most
#: Items that are indexed, and shipped to the tasks, at once; more are matched in further passes.
ITEMS_AT_ONCE, TEXT_AT_ONCE = 20_000, 16 << 20
_WORD, _SPACE = re.compile(r"\w+"), re.compile(r"[ \t\n\r]")
_FLIPS = np.array([sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint16)
#: Pairs of a window and a block's value that are looked at together; places of windows whose fingerprints are summed
#: together, besides a window's length; words and characters of a text that are looked at together, besides an item's words.
AT_ONCE, STARTS_AT_ONCE, WORDS_AT_ONCE, CHARS_AT_ONCE = 1 << 20, 2048, 100_000, 1 << 20
_ODD = np.array([2 * i + 1 for i in range(SHINGLE)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each five consecutive word hashes; of all of them if they are fewer."""
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    out = np.zeros(n if k else 0, np.uint64)
    for i in range(k):
        out = _mix(out + words[i : i + n] * _ODD[i])
    return out


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of `size` shingles at `starts`."""
    bits = np.unpackbits(_mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
    sums = np.vstack([np.zeros((1, 64)), np.cumsum(bits * weights[:, None], axis=0)])
    side = (sums[starts + size] - sums[starts] > 1e-9).astype(np.uint8)
    return np.packbits(side, axis=1).view(np.uint64).ravel()


def _block_values(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps).view(np.uint16).reshape(-1, BLOCKS)


class Block:
    """The items of one size by one block's value: a sorted list of values, and the items with each."""

    def __init__(self, values: np.ndarray):
        self.items = np.argsort(values, kind="stable")
        self.values, self.starts = np.unique(values[self.items], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of each value asked for and each item whose value differs in NEAR bits at most: the variants
        of the value are looked up."""
        wanted = asked[:, None] ^ _FLIPS
        place = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        w, f = np.nonzero(self.values[place] == wanted)
        v = place[w, f]
        n = self.ends[v] - self.starts[v]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(w, n), self.items[np.repeat(self.starts[v], n) + inside]


class Blocks:
    """The multi-index of one size."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.values = prints, _block_values(prints)
        self.blocks = [Block(v) for v in self.values.T] if len(prints) > len(_FLIPS) else []

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with a block that differs in NEAR bits at most.  Fewer items than a value has variants are
        compared block by block as they are; both ways find the same."""
        if not self.blocks:
            return np.nonzero((np.bitwise_count(_block_values(asked)[:, None] ^ self.values) <= NEAR).any(2))
        pairs = [w * len(self.prints) + i for block, v in zip(self.blocks, _block_values(asked).T, strict=True) for w, i in [block.near(v)]]
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))

    def within(self, asked: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) whose fingerprints differ in RADIUS bits at most.  Of so few bits in four blocks, some block has
        NEAR at most, so the candidates hold them all."""
        step, found = max(1, AT_ONCE // min(len(self.prints), len(_FLIPS))), []
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            w, i = self.candidates(part)
            if len(w):
                close = np.bitwise_count(part[w] ^ self.prints[i]) <= RADIUS
                found += zip((w[close] + at).tolist(), i[close].tolist(), strict=True)
        return found


def _runs(starts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Starts of windows of k shingles in runs that overlap or touch, each within STARTS_AT_ONCE places."""
    at = 0
    while at < len(starts):
        most = int(np.searchsorted(starts, starts[at] + STARTS_AT_ONCE))
        apart = np.flatnonzero(np.diff(starts[at:most]) > k)
        end = at + int(apart[0]) + 1 if len(apart) else most
        yield starts[at:end]
        at = end


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def text_shingles(words: list[str]) -> np.ndarray:
    return shingles(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))


@dataclass
class Item:
    item_id: int | None
    size: int  # words
    counts: dict[int, int]
    weight: float
    copies: int = 1


class Index:
    """Items by their number of words, with a table of blocks for each."""

    def __init__(self, rows: list[tuple], threshold: float = THRESHOLD, counted: tuple[int, np.ndarray, np.ndarray] | None = None):
        """rows: (id, text), or (id, text, how many items are equal to it).  counted: the number of items, the shingles of
        several items in order, and how many have each; if these rows are not the whole benchmark."""
        self.threshold = threshold
        self.words: dict[str, int] = {}
        parsed = []
        for item_id, text, *copies in rows:
            words = words_of(text)
            if words:
                parsed.append((item_id, len(words), text_shingles(words), *(copies or [1])))
                for w in words:
                    self.words.setdefault(w, len(self.words) + 1)
        self.word_hashes = np.array([0, *map(xxhash.xxh3_64_intdigest, self.words)], np.uint64)
        seen: Counter = Counter()
        for _, _, h, copies in parsed:
            for x in set(h.tolist()):
                seen[x] += copies
        if counted is None:
            several = sorted(s for s, n in seen.items() if n > 1)
            counted = sum(c for *_, c in parsed), np.array(several, np.uint64), np.array([seen[s] for s in several], np.int64)
        total, self.several, with_it = counted
        self.rare = 1 + math.log((1 + total) / 2)
        self.several_weight = 1 + np.log((1 + total) / (1 + with_it))
        self.known = np.array(sorted(seen), np.uint64)
        self.known_weight = self.weights(self.known)
        self.items: dict[int, list[Item]] = defaultdict(list)
        prints: dict[int, list[int]] = defaultdict(list)
        for item_id, size, h, copies in parsed:
            counts = dict(Counter(h.tolist()))
            weights = self.weights(h)
            self.items[size].append(Item(item_id, size, counts, float(weights.sum()), copies))
            prints[size].append(int(fingerprints(h, weights, np.array([0]), len(h))[0]))
        self.blocks = {size: Blocks(np.array(p, np.uint64)) for size, p in prints.items()}
        self.least = {size: min(i.weight for i in items) for size, items in self.items.items()}

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.several):
            return np.full(len(hashes), self.rare)
        place = np.minimum(np.searchsorted(self.several, hashes), len(self.several) - 1)
        return np.where(self.several[place] == hashes, self.several_weight[place], self.rare)

    def within(self, size: int, fps: np.ndarray) -> list[tuple[int, int]]:
        return self.blocks[size].within(fps)

    def similarity(self, item: Item, counts: dict[int, int]) -> float:
        """Weighted Jaccard similarity of the two multisets of shingles."""
        each = self.weights(np.fromiter(counts, np.uint64, len(counts)))
        both = sum(min(n, item.counts[s]) * w for (s, n), w in zip(counts.items(), each, strict=True) if s in item.counts)
        return float(both / (item.weight + sum(n * w for n, w in zip(counts.values(), each, strict=True)) - both))

    def matches(self, text: str, first: bool = False) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each matched item, equal ones each; first: stop
        at one."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for base, words in self._pieces(text) if self.items else ():
            self._look(base, words, best, first)
            if first and best:
                break
        return [(item.item_id, *found) for (s, i), found in best.items() for item in [self.items[s][i]] for _ in range(item.copies)]

    def _pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(place of the first word, words) of stretches of a text that overlap by the longest item less a word, so that each
        window of an item's size lies in one; but for a text that is shorter, they are longer than any item."""
        longest = max(self.items)
        held, base, at, end = [], 0, 0, len(text)
        while at < end:
            cut = at + CHARS_AT_ONCE
            if cut < end:  # at white space, which no word and no rule of lower case reaches over
                space = _SPACE.search(text, cut)
                cut = space.start() if space else end
            held += _WORD.findall(text[at:cut].lower())
            at = cut
            if at < end and len(held) >= max(WORDS_AT_ONCE, 2 * longest):
                yield base, held
                base += len(held) - longest + 1
                held = held[len(held) - longest + 1 :]
        if held:
            yield base, held

    def _look(self, base: int, words: list[str], best: dict, first: bool) -> None:
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        run, n = ids > 0, len(ids)
        for size in self._short(n):
            k = min(size, n)
            for p in np.flatnonzero(np.lib.stride_tricks.sliding_window_view(run, k).all(1)).tolist():
                self._verify(size, shingles(self.word_hashes[ids[p : p + k]]), base + p, k, best)
        if n >= SHINGLE:
            both = run[: n - SHINGLE + 1].copy()
            for i in range(1, SHINGLE):
                both &= run[i : n - SHINGLE + 1 + i]
            if both.any():
                self._long(base, words, self.word_hashes[ids], ids == 0, both, best, first)

    def _short(self, n: int) -> list[int]:
        """Sizes whose windows are one shingle."""
        return [s for s in self.items if s < SHINGLE and s <= n]

    def _long(self, base: int, words: list[str], h: np.ndarray, other: np.ndarray, both: np.ndarray, best: dict, first: bool) -> None:
        at = np.flatnonzero(both)
        s = shingles(h)
        place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        hit = self.known[place] == s[at]
        if not hit.any():
            return
        shared = np.zeros(len(s))
        shared[at[hit]] = self.known_weight[place[hit]]
        total = np.concatenate([[0.0], np.cumsum(shared)])
        for size in self.items:
            k = min(size, len(h)) - SHINGLE + 1  # shingles in a window
            if size < SHINGLE or k < 1:
                continue
            starts = np.flatnonzero(total[k:] - total[:-k] >= self.threshold * self.least[size] - 1e-6)
            for near in _runs(starts, k):
                lo, hi = int(near[0]), int(near[-1]) + k
                whole = h[lo : hi + SHINGLE - 1].copy()
                for i in np.flatnonzero(other[lo : hi + SHINGLE - 1]).tolist():  # words that these items don't have
                    whole[i] = xxhash.xxh3_64_intdigest(words[lo + i])
                exact = shingles(whole)
                weights = self.weights(exact)
                for w, i in self.within(size, fingerprints(exact, weights, near - lo, k)):
                    p = int(near[w])
                    self._keep(size, i, Counter(exact[p - lo : p - lo + k].tolist()), base + p, k + SHINGLE - 1, best)
                if first and best:
                    return

    def _verify(self, size: int, hashes: np.ndarray, p: int, k: int, best: dict) -> None:
        counts = Counter(hashes.tolist())
        weights = self.weights(hashes)
        for _, i in self.within(size, fingerprints(hashes, weights, np.array([0]), len(hashes))):
            self._keep(size, i, counts, p, k, best)

    def _keep(self, size: int, i: int, counts: dict, p: int, words: int, best: dict) -> None:
        sim = self.similarity(self.items[size][i], counts)
        if sim >= self.threshold - 1e-12 and sim > best.get((size, i), (0.0,))[0]:
            best[size, i] = (sim, p, words)


def count_shingles(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, the shingles of several items in order, and how many have each; items: id, text, copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t, copies in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                if words := words_of(t.as_py()):  # a null for the item itself
                    found = [None, *np.unique(text_shingles(words)).view(np.int64).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([copies] * len(found), pa.int64())], ["shingle", "n"])

    n = items.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1 OR shingle IS NULL").toArrow()
    found, total = n.drop_null(), sum(c for s, c in zip(n["shingle"].to_pylist(), n["n"].to_pylist(), strict=True) if s is None) if n["shingle"].null_count else 0
    hashes = found["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return total, hashes[order], found["n"].to_numpy().astype(np.int64)[order]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, at_once: int = ITEMS_AT_ONCE) -> Iterator[Index]:
    """An index for each block of the items; a block has about `at_once` different ones, or TEXT_AT_ONCE characters."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // at_once), -(-size // TEXT_AT_ONCE))
    counted = count_shingles(items) if blocks > 1 else None
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield Index([tuple(r) for r in part.orderBy("item_id", "text").collect()], threshold, counted)


MATCH_SCHEMA = "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint"


def find_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: a row for each document's row and item that it contains."""
    spark, out = docs.sparkSession, None
    for index in indexes(benchmark, threshold=threshold):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in sent.value.matches(t.as_py())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in MATCH_SCHEMA.split(", ")])

        found = id_text(docs).mapInArrow(run, MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCH_SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that contain no item, with all their columns."""
    at, sent = docs.columns.index(text_col), None
    for index in indexes(benchmark, threshold=threshold):
        if sent is not None:  # written, so that no task holds the indexes of several passes
            docs = materialise(docs, "clean")
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not sent.value.matches(t.as_py() or "", first=True) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
