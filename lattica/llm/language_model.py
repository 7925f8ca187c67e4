"""Language-model scoring (operator 13): a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Tokens are words in lower case (A-Z) and an end for each text.  A token's class is itself, if it is the end or one of the WORDS
most frequent ones, else one of SUFFIXES endings of words.  The model predicts a token's class from the two classes
before it: the sum of two context vectors is multiplied with each class's vector, and its bias is added.  A word of an ending's
class has a share in the class by its count plus one; one more share is that of any unseen word.

As the logits are a sum over the two places, so the normalisers of all pairs of contexts are one matrix product:
exp(A1) exp(A2 + b)^T, where A1 and A2 are the products of the context vectors with those of the classes.  Each
worker makes these tables once, in blocks; a token's normalised log-probability is then three lookups.

Training: all words of all training documents are counted on the executors.  A first model is trained by one task on a
bounded sample (WARM_TOKENS), in which every training document has the same chance; then each task goes on with it over *all*
windows of its documents, and the models are averaged in two steps, weighted by tokens.  Minibatches share NOISE noise classes, drawn
by their frequency, so that steps are matrix products too.

Of the counts, the driver and the tasks hold those of at most HOT frequent words; all others are joined by word.

Defined results: null and empty texts are an end alone.  A row without an id is a training row.  Repeated rows count each and
score alike.  Without training rows every class is as likely as any other, and all words share one class.  Only the id and
the text are read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, remembered, slices

#: Classes that are words, and endings of words (code points of one); values in a vector; noise classes of a minibatch.
WORDS, SUFFIXES, SUFFIX = 1535, 767, 3
SIZE, NOISE, BATCH, RATE = 24, 32, 2048, 0.1
#: Tokens that the first model is trained on, about, in at most WARM_EPOCHS passes over fewer.
WARM_TOKENS, WARM_EPOCHS = 1_500_000, 4
#: Frequent words whose counts are sent to all tasks, at most; other words that a task remembers.
HOT, MEMORY = 200_000, 100_000
#: Models that the driver averages, at most; tasks' models are averaged in so many times as many groups before.
BUCKETS = 16
END = "\n"
LOG10 = float(np.log(10))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and space and 9 to 13


def suffix_of(word: bytes) -> str:
    return word[-4 * SUFFIX :].decode("utf-8", "ignore")[-SUFFIX:]


@dataclass
class Vocabulary:
    """What tasks know of the counted words: frequent words with counts, and the classes' masses."""

    total: int  # tokens
    distinct: int
    hot: list[bytes]
    hot_counts: np.ndarray
    hot_class: np.ndarray
    suffixes: dict[str, int]
    mass: np.ndarray  # tokens of each class
    types: np.ndarray  # words of each class that is an ending; 0 for others

    @property
    def other(self) -> int:
        return len(self.mass) - 1

    def class_of(self, word: bytes) -> int:
        """The class of a word that isn't frequent."""
        return self.suffixes.get(suffix_of(word), self.other)

    def shares(self) -> np.ndarray:
        """Of each class: log10 of what a word's count plus one is divided by; 0 for classes of one word."""
        return np.where(self.types >= 0, np.log10(np.maximum(self.mass + self.types + 1, 1)), 0.0)


class _Codes(dict):
    """Words' places among the frequent ones, or -1 - class."""

    def __init__(self, v: Vocabulary):
        super().__init__(zip(v.hot, range(len(v.hot)), strict=True))
        self.v = v

    def __missing__(self, word: bytes) -> int:
        code = self[word] = -1 - self.v.class_of(word)
        return code

    def trim(self) -> None:
        if len(self) > len(self.v.hot) + MEMORY:
            self.clear()
            self.update(zip(self.v.hot, range(len(self.v.hot)), strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.v.hot_class[np.maximum(codes, 0)], -1 - codes).astype(np.int32)


def windows(classes: np.ndarray) -> np.ndarray:
    """(class two before, class before, class) of each token of a text, the end included."""
    s = np.zeros(len(classes) + 3, np.int32)  # 0: the end, also before a text
    s[2:-1] = classes
    return np.stack([s[:-2], s[1:-1], s[2:]])


@dataclass
class Weights:
    """Vectors of the contexts and classes, biases, and sums of squared gradients of each row."""

    far: np.ndarray
    near: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    squares: np.ndarray  # a row each for far, near, target and bias

    def copy(self) -> Weights:
        return Weights(*[a.copy() for a in (self.far, self.near, self.target, self.bias, self.squares)])

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.far, self.near, self.target, self.bias, self.squares)]).astype(np.float32)

    @staticmethod
    def unpack(flat: np.ndarray, classes: int, size: int) -> Weights:
        n, at, out = classes * size, 0, []
        for count, shape in ((n, (classes, size)),) * 3 + ((classes, (classes,)), (4 * classes, (4, classes))):
            out.append(flat[at : at + count].reshape(shape).astype(np.float32))
            at += count
        return Weights(*out)

    @staticmethod
    def begin(mass: np.ndarray, size: int = SIZE, seed: int = 20250117) -> Weights:
        rng, n = np.random.default_rng(seed), len(mass)
        make = lambda: (rng.normal(size=(n, size)) * 0.1).astype(np.float32)
        return Weights(make(), make(), make(), np.log((mass + 1) / (mass + 1).sum()).astype(np.float32), np.full((4, n), 0.1, np.float32))


class Trainer:
    """Noise-contrastive estimation in minibatches, with steps scaled by each row's past gradients."""

    def __init__(self, weights: Weights, mass: np.ndarray, seed: int, noise: int = NOISE):
        self.w, self.noise, self.rng = weights, noise, np.random.default_rng(seed)
        p = (mass + 1) / (mass + 1).sum()
        self.cumulative, self.offset = np.cumsum(p), np.log(noise * p).astype(np.float32)

    def _move(self, which: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """One step of the rows named, of the sum of their gradients."""
        values = (self.w.far, self.w.near, self.w.target, self.w.bias)[which]
        if len(values) <= 1 << 16:
            rows = rows.astype(np.uint16)  # sorted by radix
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        own, total = ranked[first], np.add.reduceat(gradient[order], first, axis=0)
        squares = self.w.squares[which]
        squares[own] += total * total if total.ndim == 1 else (total * total).mean(1)
        scale = RATE / np.sqrt(squares[own])
        values[own] += total * (scale if total.ndim == 1 else scale[:, None])

    def step(self, far: np.ndarray, near: np.ndarray, seen: np.ndarray) -> None:
        """Raise the logits of the classes seen against those of the noise."""
        w = self.w
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise) * self.cumulative[-1]), len(self.cumulative) - 1).astype(np.int32)
        context = w.far[far] + w.near[near]
        target, other = w.target[seen], w.target[noise]
        good = np.einsum("ij,ij->i", context, target) + w.bias[seen] - self.offset[seen]
        bad = context @ other.T + (w.bias[noise] - self.offset[noise])
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        back = up[:, None] * target + down @ other
        self._move(2, np.concatenate([seen, noise]), np.concatenate([up[:, None] * context, down.T @ context]))
        self._move(3, np.concatenate([seen, noise]), np.concatenate([up, down.sum(0)]))
        self._move(0, far, back)
        self._move(1, near, back)

    def learn(self, w: np.ndarray) -> None:
        for i in range(0, w.shape[1], BATCH):
            self.step(*w[:, i : i + BATCH])


class Tables:
    """Log-probabilities by lookup: logits of the two contexts and the normalisers of all their pairs."""

    def __init__(self, w: Weights, block: int = 256):
        self.far, self.near = w.far @ w.target.T, w.near @ w.target.T + w.bias
        top = self.near.max(1)
        near = np.exp(self.near - top[:, None]).T
        self.total = np.empty_like(self.far)
        for i in range(0, len(self.far), block):
            rows = self.far[i : i + block]
            most = rows.max(1, keepdims=True)
            self.total[i : i + block] = np.log(np.maximum(np.exp(rows - most) @ near, 1e-37)) + most
        self.total += top

    def log_probability(self, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the windows' last classes."""
        far, near, seen = w
        return self.far[far, seen].astype(np.float64) + self.near[near, seen] - self.total[far, near]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: Weights
    counts: DataFrame | None  # token, c: all words, on the executors


# ---------------------------------------------------------------- counts


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over whole texts; a task sums up to MEMORY words before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
        for b in slices(batches):
            for t in b.column(1):
                seen.update(words_of(t.as_py()))
                if len(seen) > MEMORY:
                    yield flush()
                    seen.clear()
            seen[END.encode()] += b.num_rows
        if seen:
            yield flush()

    return docs.mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, words: int = WORDS, suffixes: int = SUFFIXES, hot: int = HOT) -> Vocabulary:
    """From written counts.  Frequent words are those of the highest classes of counts (eight to a doubling) that have
    at most `hot` words together, so that no sort of all words is needed."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = {r["level"]: (r["words"], r["tokens"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()}
    distinct, total = sum(n for n, _ in levels.values()), sum(c for _, c in levels.values())
    room, least = hot, None
    for k in sorted(levels, reverse=True):
        room -= levels[k][0]
        if room < 0:
            break
        least = k
    frequent = counts.where(level >= least).toArrow() if least is not None else pa.table({"token": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    pairs = sorted(zip(frequent["token"].to_pylist(), frequent["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    chosen = [t for t, _ in pairs if t != END][:words]
    own = {END: 0} | {t: i + 1 for i, t in enumerate(chosen)}
    single = counts.sparkSession.createDataFrame([(t,) for t in own], "token string")
    ending = counts.join(F.broadcast(single), "token", "left_anti").groupBy(F.expr(f"right(token, {SUFFIX})").alias("suffix")).agg(F.sum("c").alias("mass"), F.count("*").alias("types"))
    top = [tuple(r) for r in ending.orderBy(F.desc("mass"), "suffix").limit(suffixes).collect()]
    ends = {s: len(own) + i for i, (s, _, _) in enumerate(top)}
    mass, types = np.zeros(len(own) + len(top) + 1), np.full(len(own) + len(top) + 1, -1.0)
    known = dict(pairs)
    mass[0] = counts.where(F.col("token") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    for t in chosen:
        mass[own[t]] = known[t]
    for s, m, n in top:
        mass[ends[s]], types[ends[s]] = m, n
    mass[-1], types[-1] = total - mass.sum(), distinct - (len(chosen) + (mass[0] > 0)) - sum(n for _, _, n in top)
    tokens = [t.encode() for t, _ in pairs if t != END]
    v = Vocabulary(total, distinct, tokens, np.array([c for t, c in pairs if t != END], np.int64), np.zeros(max(1, len(tokens)), np.int32), ends, mass, types)
    if tokens:
        v.hot_class[:] = [own.get(t.decode(), -1) if t.decode() in own else v.class_of(t) for t in tokens]
    return v


# ---------------------------------------------------------------- training


def _windows(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[np.ndarray]:
    """Windows of some documents at a time."""
    codes = remembered(f"language model {id(v)}", lambda: _Codes(v))
    for b in slices(batches, 100):
        codes.trim()
        yield np.concatenate([windows(codes.classes(codes.of(words_of(t.as_py())))) for t in b.column(1)], axis=1)


_PACKED = "bucket int, tokens bigint, packed binary"


def _batch(bucket: int, tokens: int, packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([tokens], pa.int64()), pa.array([packed.astype(np.float32).tobytes()], pa.binary())], ["bucket", "tokens", "packed"])


def train(docs: DataFrame, v: Vocabulary, size: int = SIZE, warm_tokens: int = WARM_TOKENS) -> Weights:
    """The averaged model of all documents (doc_id, text)."""
    spark, classes = docs.sparkSession, len(v.mass)
    start = Weights.begin(v.mass, size)
    if not v.total:
        return replace(start, far=start.far * 0, near=start.near * 0)
    sent, share = spark.sparkContext.broadcast(v), warm_tokens / v.total

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, n = sent.value, [], 0
        for w in _windows(batches, v):
            held.append(w)
            n += w.shape[1]
            if n > 2 * warm_tokens:
                break
        if n:
            every = np.concatenate(held, axis=1)[:, : 2 * warm_tokens]
            t = Trainer(Weights.begin(v.mass, size), v.mass, 1)
            for i in range(max(1, min(WARM_EPOCHS, warm_tokens // n))):
                t.learn(every[:, np.random.default_rng(i).permutation(every.shape[1])])
            yield _batch(0, n, t.w.pack())

    some = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int((1 << 32) * share)))
    first = some.repartition(1).mapInArrow(warm, _PACKED).collect()
    begun = Weights.unpack(np.frombuffer(first[0]["packed"], np.float32), classes, size) if first else start
    if share >= WARM_EPOCHS:  # every window has been seen as often as the first model sees any
        return begun
    given = spark.sparkContext.broadcast(begun.pack())

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, at, n = sent.value, TaskContext.get().partitionId(), 0
        t = Trainer(Weights.unpack(given.value, len(v.mass), size), v.mass, at + 2)
        for w in _windows(batches, v):
            t.learn(w[:, t.rng.permutation(w.shape[1])])
            n += w.shape[1]
        if n:
            yield _batch(at % (BUCKETS * BUCKETS), n, t.w.pack())

    def average(table: pa.Table) -> pa.Table:
        tokens = table["tokens"].to_pylist()
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) * (n / sum(tokens)) for x, n in zip(table["packed"], tokens, strict=True))
        return pa.Table.from_batches([_batch(table["bucket"][0].as_py(), sum(tokens), total)])

    some = docs.mapInArrow(go_on, _PACKED).groupBy("bucket").applyInArrow(average, _PACKED)
    rows = some.withColumn("bucket", F.col("bucket") % BUCKETS).groupBy("bucket").applyInArrow(average, _PACKED).collect()
    tokens = sum(r["tokens"] for r in rows)
    return Weights.unpack(sum(np.frombuffer(r["packed"], np.float32).astype(np.float64) * (r["tokens"] / tokens) for r in rows), classes, size)


def fit(docs: DataFrame, where: Column | None = None) -> Model:
    """The model of the documents that meet the condition (on doc_id and text)."""
    d = id_text(docs)
    d = d if where is None else d.where(where)
    counts = materialise(count_tokens(d), "lm-counts")
    v = vocabulary(counts)
    return Model(v, train(d, v), counts)


# ---------------------------------------------------------------- scores


@dataclass
class Scorer:
    """A worker's tables."""

    v: Vocabulary
    codes: _Codes
    tables: Tables
    logs: np.ndarray
    within: np.ndarray
    shares: np.ndarray

    @staticmethod
    def make(v: Vocabulary, w: Weights) -> Scorer:
        shares, logs = v.shares(), np.log10(v.hot_counts + 1.0)
        single = v.types[v.hot_class[: len(logs)]] < 0
        return Scorer(v, _Codes(v), Tables(w), logs, np.where(single, 0.0, logs - shares[v.hot_class[: len(logs)]]), shares)

    def score(self, text: str) -> tuple[int, int, float, float, Counter]:
        """(tokens, frequent ones, their log10 of count plus one, log10 probability as far as it is known, other words)."""
        words = words_of(text)
        codes = self.codes.of(words)
        hot = codes >= 0
        own, classes = codes[hot], self.codes.classes(codes)
        model = float(self.tables.log_probability(windows(classes)).sum()) / LOG10
        model += float(self.within[own].sum()) - float(self.shares[classes[~hot]].sum())
        rest = Counter(words[i] for i in np.flatnonzero(~hot).tolist())
        ends = self.v.mass[0]
        return len(words) + 1, int(hot.sum()) + (ends > 0), float(self.logs[own].sum() + np.log10(ends + 1)), model, rest


def score(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    spark, v = docs.sparkSession, model.vocabulary
    sent = spark.sparkContext.broadcast((v, model.weights.pack(), model.weights.far.shape[1]))
    kind = pa.struct([("rows", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Scorer:
            v, packed, size = sent.value
            return Scorer.make(v, Weights.unpack(packed, len(v.mass), size))

        scorer = remembered(f"language model scorer {id(sent.value[0])}", make)
        for b in slices(batches, 200):
            scorer.codes.trim()
            ids, digests, tokens, counts, own = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                n, known, base, log, rest = scorer.score(text)
                digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                ids += [i] * (1 + len(rest))
                digests += [digest] * (1 + len(rest))
                tokens += [f"\n{i} {digest}".encode(), *rest]  # a key of its own, so that these rows don't meet in one task
                counts += [0, *rest.values()]
                own += [(1, n, known, base, log), *[None] * len(rest)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(own, kind)], ["doc_id", "digest", "token", "n", "own"])

    found = id_text(docs).mapInArrow(run, "doc_id bigint, digest bigint, token string, n bigint, own struct<rows: bigint, n: bigint, known: bigint, base: double, score: double>")
    least = int(v.hot_counts.min()) if len(v.hot) else None
    others = model.counts if least is None else model.counts.where(F.col("c") < least)  # the frequent ones are known already
    joined = found.join(others, "token", "left")
    sums = joined.groupBy("doc_id", "digest").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rest"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known"),
        *[F.sum(f"own.{c}").alias(c) for c in ("rows", "n", "known", "base", "score")],
    )
    per = lambda c: F.col(c) / F.col("rows")  # noqa: E731  rows that agree in id and text
    out = sums.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
    n_tokens = F.expr("n div rows")
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        n_tokens.alias("n_tokens"),
        F.expr("(known + rest_known) div rows").alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (per("base") + per("rest") - n_tokens * float(np.log10(v.total + v.distinct + 1))).alias("base_score"),
        (per("score") + per("rest")).alias("score"),
    )
