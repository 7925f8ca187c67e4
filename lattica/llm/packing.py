"""Packing (operator 2): documents into token sequences, in order, by dynamic programming.

A task's documents are one stream of tokens in the order of the table.  Candidate cuts are the ends of
documents and of sentences, and, where those are far apart, fixed steps between.  Dynamic programming
chooses the cuts that minimise padding plus penalties for documents that are cut; as a sequence's
padding is linear in its length, the best predecessor of each cut is a sliding-window minimum, kept in
a monotone queue.  A stream is cut at its last document end into sequences of at most `limit` tokens;
what remains at a task's end is cut into powers of two, which need no padding.

Nothing is shuffled: a task holds one span of the stream at a time, whatever its input.  Sequence ids
hold the partition and a running number, so that a task that runs again gives the same rows.

Defined results: a null or empty text is its end mark alone.  Repeated rows are all packed.  A null id
is kept as null.  An empty table gives no rows.  Other input columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, remembered, slices

LIMIT = 4096
END_ID = 2
#: Penalties, in tokens of padding, for a cut at a sentence's end and for one inside a sentence: a sentence is cut only
#: where the boundaries in reach would cost more padding than that.
SENTENCE_CUT, INNER_CUT = 2, 300
#: Tokens between candidate cuts where no sentence ends.
INNER_STEP = 24
#: Tokens of the stream that are packed at once; words whose ids a worker remembers.
SPAN = 1 << 20
MEMORY_WORDS = 800_000

_SPLITS_OTHERWISE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#]*)")


class Encoder(dict):
    """Ids of whole texts.  The tokenizer splits at white space and between letters and marks, so the ids of a
    text are those of its words in turn, and those of a plain word are its letters' and its marks'.

    As a dictionary, it remembers the ids (bytes) of words, and finds out those of others."""

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.memory_words = memory_words
        self.letters: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.byte_level = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(128, 256)}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+[\"')\]]*(</w>)?", t)]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True

    def exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        known = self.letters.get(part)
        if known is None:
            level = part if part.isascii() else part.translate(self.byte_level)
            known = self.letters[part] = _ids_bytes([t.id for t in self.tokenize(level)])
        return known

    def __missing__(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if not m:
            ids = self.exact(word)
        else:
            letters, marks = m.groups()
            ids = self._part(letters.lower())
            if marks:
                ids += self._part(marks)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if _SPLITS_OTHERWISE.search(text):
            return self.exact(text)
        if len(self) > self.memory_words:
            self.clear()
            self.letters.clear()
        return b"".join(map(self.__getitem__, text.split()))


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def choose_cuts(at: list[int], cost: list[int], start: int, limit: int) -> list[int]:
    """Positions from `at` (ascending) that end sequences, the first of which starts at `start`: the last of `at`
    is reached with the least sum of padding to `limit` and of the cuts' costs.  No two neighbours, and not
    `start` and the first, may be further apart than `limit`.

    best[j] = min over i with at[j] - at[i] <= limit of best[i] + at[i], plus limit - at[j] + cost[j]."""
    n = len(at)
    back, value = [0] * n, [0] * n
    queue = deque([(start, -1, start)])  # (position, index, best + position), the last part ascending
    pop, pop_left, push = queue.pop, queue.popleft, queue.append
    for j in range(n):
        p = at[j]
        least = p - limit
        while queue[0][0] < least:
            pop_left()
        _, i, v = queue[0]
        back[j] = i
        v += limit + cost[j]  # best[j] + at[j]
        while queue and queue[-1][2] >= v:
            pop()
        push((p, j, v))
    cuts, j = [], n - 1
    while j >= 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts (positions after a token) up to the last document's end, and their costs."""
    place = np.zeros(len(ids) + 1, bool)
    place[1:] = is_end[ids]
    marks = np.flatnonzero(place)
    place[doc_ends] = True
    known = np.flatnonzero(place)
    step = min(INNER_STEP, limit)
    before = np.concatenate([[0], known[:-1]])
    more = (known - before - 1) // step  # inner candidates of each gap
    number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    place[np.repeat(before, more) + number * step] = True
    at = np.flatnonzero(place)
    cost = np.full(len(ids) + 1, INNER_CUT, np.int64)
    cost[marks] = SENTENCE_CUT
    cost[doc_ends] = 0
    return at, cost[at]


def powers(start: int, end: int, limit: int) -> list[int]:
    """Ends of sequences that cover a rest: whole ones, then falling powers of two, which are not padded."""
    cuts = []
    while start < end:
        start += limit if end - start >= limit else 1 << ((end - start).bit_length() - 1)
        cuts.append(start)
    return cuts


class Packer:
    def __init__(self, first_sequence: int, is_end: np.ndarray, limit: int = LIMIT):
        self.sequence, self.is_end, self.limit = first_sequence, is_end, limit
        self.docs: list[tuple] = []  # (doc_id, ids as bytes, tokens of the document before them)
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids) // 4))
        self.tokens += len(ids) // 4
        return self.flush() if self.tokens >= SPAN else []

    def flush(self, last: bool = False) -> list[tuple]:
        """Pieces of what is held: (doc_id, start, length, crc32, doc_tokens, sequence_id, offset).  All but the last
        sequences' worth, unless no more is to come; what is left starts the next span."""
        if not self.docs:
            return []
        ends = np.cumsum([len(d[1]) // 4 for d in self.docs])
        ids = np.frombuffer(b"".join(d[1] for d in self.docs), "<u4")
        at, cost = candidates(ids, ends, self.is_end, self.limit)
        cuts = choose_cuts(at.tolist(), cost.tolist(), 0, self.limit)
        if last:
            cuts = cuts[:-1] if len(cuts) > 1 else []
            cuts += powers(cuts[-1] if cuts else 0, len(ids), self.limit)
        else:
            cuts = cuts[:-2]  # the last ones would be chosen otherwise if the stream were seen further
        rows, left, k, doc_from = [], 0, 0, 0
        held = memoryview(ids).cast("B")
        for cut in cuts:
            offset = 0
            while left < cut:
                doc_id, _, before, total = self.docs[k]
                to = min(int(ends[k]), cut)
                rows.append((doc_id, before + left - doc_from, to - left, zlib.crc32(held[4 * left : 4 * to]), total, self.sequence, offset))
                offset += to - left
                left = to
                if to == ends[k]:
                    k, doc_from = k + 1, to
            self.sequence += 1
        rest = self.docs[k:]
        if rest and left > doc_from:
            doc_id, b, before, total = rest[0]
            rest[0] = (doc_id, b[4 * (left - doc_from) :], before + left - doc_from, total)
        self.docs, self.tokens = rest, int(len(ids) - left)
        return rows


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document.

    memory_words: words whose ids each Python worker remembers, at some 250 bytes each."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(f"encoder {tokenizer_path} {memory_words}", lambda: Encoder(tokenizer_path, memory_words))
        packer = Packer(TaskContext.get().partitionId() << 40, encoder.is_end, limit)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if rows := packer.add(doc_id, encoder.encode(text.as_py()) + end):
                    yield batch(rows)
        if rows := packer.flush(last=True):
            yield batch(rows)

    return id_text(docs).mapInArrow(run, ", ".join(f"{n} bigint" for n in NAMES))
