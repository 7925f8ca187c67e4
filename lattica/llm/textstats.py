"""Statistics of one whole text, in time and memory proportional to it."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT = 8  # words in a window
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_MIX = np.random.default_rng(20250117).integers(1, 2**63, REPEAT, dtype=np.uint64) | np.uint64(1)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_same_as_last", "n_distinct", "n_upper", "n_marks")


def repeat_words(hashes: np.ndarray) -> int:
    """Words lying in some window of eight that occurs at least twice.  Windows are compared by 64-bit hashes
    of their words' 64-bit hashes."""
    n = len(hashes) - REPEAT + 1
    if n < 2:
        return 0
    h = hashes[:n] * _MIX[0]
    for k in range(1, REPEAT):
        h += hashes[k : k + n] * _MIX[k]
    s = np.sort(h)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.flatnonzero(np.isin(h, s[1:][same]))
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[hit] += 1
    edge[hit + REPEAT] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS and EXTRA.  An empty text: all zero."""
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return (0,) * 10
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(hashes),
        len(lines),
        int((hashes[1:] == hashes[:-1]).sum()),
        len(set(words)),
        len(text.encode("utf-8", "surrogatepass").translate(None, _NOT_UPPER)),
        text.count("!") + text.count("?"),
    )


def counts_of(texts) -> np.ndarray:
    """A row of ten counts for each text (None: empty)."""
    return np.array([text_counts(t or "") for t in texts], np.int64).reshape(-1, 10)


def rates(c: np.ndarray) -> np.ndarray:
    """Transformed statistics that hardly depend on a text's length: float64, one row a text.  Ten words and
    ten lines without findings are added to each text, so that short ones don't have extreme rates by chance."""
    c = c.astype(np.float64)
    n, lines = c[:, 0] + 10, c[:, 5] + 10
    return np.column_stack(
        [
            np.log1p(c[:, 1] / np.maximum(c[:, 0], 1)),
            np.log1p(100 * c[:, 2] / n),
            np.sqrt(c[:, 3] / lines),
            np.sqrt(c[:, 4] / n),
            np.sqrt(c[:, 6] / n),
            np.log1p(4 * c[:, 9] / n),
            np.sqrt(c[:, 8] / (c[:, 1] + 50)),
        ]
    )
