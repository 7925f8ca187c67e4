"""License scans (operator 5) by conditional compression.

Stretches of words around licensing words are compressed alone and with each template as zstandard raw dictionary; templates
are ranked by the bytes that they save.  In this order, each that saves a fair share of its own size is compared with
the stretch word by word: the words that agree best with it are aligned exactly (the fewest words missing and added, over
all places), and confirmed if few words differ and none of the words that tell licenses apart (names, versions,
conditions such as NonCommercial, negations).  A block reaches over such words beside it, so that "version 2" isn't cut
off.  Words between confirmed blocks are scanned again until nothing more is found.  A block that is worded
like a template but for a telling word is reported as `unknown`, with the template that it is nearest to.

Defined results: null and empty texts, and texts without a licensing word, have no blocks.  Repeated
rows are reported alike.  A null id is kept as null.  Templates that save equally are tried by
name.  Long texts are read whole; only stretches around licensing words are compressed.  Other input columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

#: Wording of public license notices.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0 notice": _GNU.format(what="program", colon=";", name="General Public License", version="2"),
    "GPL-3.0 notice": _GNU.format(what="program", colon=":", name="General Public License", version="3"),
    "LGPL-2.1 notice": _GNU.format(what="library", colon=";", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0 notice": _GNU.format(what="program", colon=":", name="Lesser General Public License", version="3"),
    "AGPL-3.0 notice": _GNU.format(what="program", colon=":", name="Affero General Public License", version="3"),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "All-rights-reserved": "All rights reserved.",
}
#: The conditions of Creative Commons licenses by their letters, and the versions in use.
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _letters, _words in CREATIVE_COMMONS.items():
    for _version, _port in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_letters}-{_version}"] = f"Licensed under CC {_letters} {_version}."
        TEMPLATES[f"CC-{_letters}-{_version} notice"] = f"This work is licensed under a Creative Commons {_words} {_version} {_port} License."
CUE = r"(?i)licen[cs]e|copyright|permission|warrant|rights reserved|redistribut|SPDX|creative commons|public domain"
#: Share of a template's own compressed size that it must save to be compared, share of a block's size that it must save
#: to be confirmed, and the share of its words that may differ.
MIN_SHARE, MIN_REDUCTION, MAX_CHANGED = 0.15, 0.25, 0.2
#: Level of compression; what stands before all data.
LEVEL = 6
_PREAMBLE = 2 * b"zq~ 0x7f jw9k vb#5 "
UNKNOWN = "unknown"
#: Words that tell licenses apart, besides those with digits (fixed values), and those that deny a license.
TELLING = frozenset(
    "apache mit isc bsd gnu gpl lgpl agpl lesser library affero mozilla mpl eclipse epl creative commons cc cc0 by by-sa by-nd by-nc by-nc-sa by-nc-nd attribution attribution-sharealike attribution-noderivatives attribution-noncommercial attribution-noncommercial-sharealike attribution-noncommercial-noderivatives noncommercial non-commercial sharealike noderivatives noderivs nc nd sa unported only neither endorse promote advertising domain unencumbered waived all rights reserved not no never without".split()
)
_NEGATION = frozenset("not no never neither non without isn't cannot".split())
#: Words between a name and its version.
_LINKS = frozenset("version versions v licence license".split())
_CUE, _WORD = re.compile(CUE), re.compile(r"[\w.+'-]+")
_YEAR, _STOP = re.compile(r"(19|20)\d\d(-(19|20)?\d\d)?"), re.compile(r"[.;:!?](\s|$)|\n\s*\n")


def telling(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word) and not _YEAR.fullmatch(word)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of each word."""
    out = []
    for m in _WORD.finditer(text):
        if w := m[0].strip(".-+'"):
            start = m.start() + m[0].index(w)
            out.append((w.lower(), start, start + len(w)))
    return out


def words_of(text: str) -> list[str]:
    return [w for w, _, _ in spans_of(text)]


class Block(NamedTuple):
    saved: int  # bytes
    reduction: float
    missing: int
    added: int
    name: str
    start: int  # words
    end: int
    nearest: str


class Template:
    def __init__(self, name: str, text: str, vocabulary: dict[str, int], compressor):
        self.name, self.compressor = name, compressor
        self.words = words_of(text)
        self.ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in self.words]
        self.telling = [w for w in self.words if telling(w)]
        self.limit = int(MAX_CHANGED * len(self.ids) + 1e-9)
        self.wide = max(2, self.limit) if len(self.ids) > 3 else self.limit  # of what may be reported as unknown
        self.reach = len(self.ids) + self.wide  # words of the longest block
        self.size = 1  # bytes, compressed alone

    def align(self, ids: np.ndarray, words: list[str] | None = None) -> list[tuple[int, int, int]]:
        """(differences, first word, word after the last) of disjoint stretches: first those with the same telling words
        (where words are given), of these those with the fewest differences."""
        n, reach = len(self.ids), min(self.reach, len(ids))
        own = np.concatenate([[0], np.cumsum(np.isin(ids, self.ids))])
        if not n or not len(ids) or (own[reach:] - own[:-reach]).max() < n - self.wide:
            return []
        # a cell is differences * unit - start, so the least has the fewest differences, and of these the shortest stretch
        unit = len(ids) + 1
        steps = np.arange(unit, dtype=np.int64) * unit
        cost = -np.arange(unit, dtype=np.int64)
        for w in self.ids:
            new = cost + unit
            new[1:] = np.minimum(new[1:], np.where(ids == w, cost[:-1], new[1:]))
            cost = np.minimum.accumulate(new - steps) + steps
        changed = -(-cost // unit)
        start = changed * unit - cost
        ends = np.flatnonzero(changed <= self.wide)
        taken, out = np.zeros(len(ids), bool), []
        other = [words is not None and [w for w in words[start[e] : e] if telling(w)] != self.telling for e in ends.tolist()]
        for e in ends[np.lexsort((changed[ends], other))].tolist():
            if not taken[start[e] : e].any():
                taken[start[e] : e] = True
                out.append((int(changed[e]), int(start[e]), e))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, min_share: float = MIN_SHARE):
        templates, self.min_share = templates or TEMPLATES, min_share
        make = lambda **more: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        self.alone = make()
        self.vocabulary: dict[str, int] = {}
        self.templates = []
        for name, text in sorted(templates.items()):
            data = zstandard.ZstdCompressionDict(_plain(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            t = Template(name, text, self.vocabulary, make(dict_data=data))
            t.size = max(1, self._size(self.alone, _plain(text)))
            self.templates.append(t)

    def _size(self, compressor, data: bytes) -> int:
        """Compressed bytes behind a preamble that has a repetition: what a first match costs is not the data's."""
        return max(0, len(compressor.compress(_PREAMBLE + data)) - len(compressor.compress(_PREAMBLE)))

    def saving(self, block: str, compressor) -> tuple[int, float]:
        """Bytes saved by a template, and their share of the block's compressed size: 1 is as short as nothing, 0 no help."""
        data = _plain(block)
        plain = max(1, self._size(self.alone, data))
        got = self._size(compressor, data)
        return plain - got, 1 - got / plain

    def ranked(self, stretch: str) -> list[tuple[int, Template]]:
        """(bytes saved, template): those that save min_share of their own size at least, the one that saves most first."""
        data = _plain(stretch)
        plain = self._size(self.alone, data)
        saved = [(plain - self._size(t.compressor, data), t) for t in self.templates]
        return sorted(((n, t) for n, t in saved if n >= self.min_share * t.size), key=lambda x: (-x[0], x[1].name))

    def blocks(self, text: str) -> list[Block]:
        """The confirmed and unknown blocks, in order."""
        words = spans_of(text)
        starts = [s for _, s, _ in words]
        cues = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in _CUE.finditer(text)}) if words else []
        ids = np.array([self.vocabulary.get(w, 0) for w, _, _ in words], np.int64)
        reach, areas = max(t.reach for t in self.templates), []
        for c in cues:
            if areas and c - reach < areas[-1][1]:
                areas[-1][1] = min(len(ids), c + reach)
            else:
                areas.append([max(0, c - reach), min(len(ids), c + reach)])
        return sorted((b for lo, hi in areas for b in self._confirmed(text, words, ids, lo, hi)), key=lambda b: b.start)

    def _extent(self, text: str, words: list, start: int, end: int) -> tuple[int, int, bool]:
        """A block with the telling words beside it in its sentence, and whether it is denied."""
        beside = lambda i: not _STOP.search(text, words[i][2], words[i + 1][1] + 1)
        while end < len(words) and beside(end - 1):
            if telling(words[end][0]) and words[end][0] not in _NEGATION:
                end += 1
            elif words[end][0] in _LINKS and end + 1 < len(words) and telling(words[end + 1][0]) and beside(end):
                end += 2
            else:
                break
        denied = False
        for i in range(start - 1, max(-1, start - 4), -1):
            if not beside(i):
                break
            denied |= words[i][0] in _NEGATION
        return start, end, denied

    def _judged(self, text: str, words: list, t: Template, changed: int, a: int, b: int) -> Block | None:
        """The block at an aligned stretch: confirmed, unknown, or none."""
        start, end, denied = self._extent(text, words, a, b)
        said = [w for w, _, _ in words[start:end] if telling(w)]
        changed += end - b
        more = end - start - len(t.ids)
        saved, reduction = self.saving(text[words[start][1] : words[end - 1][2]], t.compressor)
        if reduction < MIN_REDUCTION:
            return None
        same = said == t.telling and not denied
        if not (same and changed <= t.limit or not same and said):
            return None
        return Block(saved, reduction, (changed - more) // 2, (changed + more) // 2, t.name if same else UNKNOWN, start, end, t.name)

    def _found(self, text: str, words: list, ids: np.ndarray, lo: int, hi: int) -> list[Block]:
        """Blocks of the template that saves most in a stretch and is confirmed; else the unknown ones, nearest first."""
        unknown = []
        for _, t in self.ranked(text[words[lo][1] : words[hi - 1][2]]):
            taken, kept = np.zeros(len(words), bool), []
            for changed, a, b in t.align(ids[lo:hi], [w for w, _, _ in words[lo:hi]]):
                block = self._judged(text, words, t, changed, lo + a, lo + b)
                if block is None or block.end > hi or taken[block.start : block.end].any():
                    continue
                if block.name == UNKNOWN:
                    unknown.append(block)
                else:
                    taken[block.start : block.end] = True
                    kept.append(block)
            if kept:
                return kept
        taken, kept = np.zeros(len(words), bool), []
        for b in sorted(unknown, key=lambda b: (b.missing + b.added, -b.saved, b.nearest, b.start)):
            if not taken[b.start : b.end].any():
                taken[b.start : b.end] = True
                kept.append(b)
        return kept

    def _confirmed(self, text: str, words: list, ids: np.ndarray, lo: int, hi: int) -> list[Block]:
        """Disjoint blocks; what lies between them is scanned again until nothing more is found."""
        out, todo = [], [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            kept = sorted(self._found(text, words, ids, lo, hi), key=lambda b: b.start)
            if kept:
                out += kept
                ends = [lo, *(x for b in kept for x in (b.start, b.end)), hi]
                todo += [(a, z) for a, z in list(pairwise(ends))[::2] if a < z]
        return out

    def confirm(self, block: str) -> tuple[str, float, int, int] | None:
        """(template, reduction, words missing, words added) of the confirmed block that saves most."""
        best = max((b for b in self.blocks(block) if b.name != UNKNOWN), key=lambda b: b.saved, default=None)
        return best and (best.name, best.reduction, best.missing, best.added)

    def scan(self, text: str) -> list[tuple]:
        """(first line, lines, template or unknown, reduction, words missing, words added, block, nearest template) of each block."""
        words, out, line, at = None, [], 0, 0
        for b in self.blocks(text):
            words = words or spans_of(text)
            start, end = words[b.start][1], words[b.end - 1][2]
            line, at = line + text.count("\n", at, start), start
            block = text[start:end]
            out.append((line, 1 + block.count("\n"), b.name, b.reduction, b.missing, b.added, block, b.nearest))
        return out


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


SCHEMA = "doc_id bigint, line bigint, n_lines bigint, license string, reduction double, words_missing bigint, words_added bigint, block string, nearest string"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line (from 0), n_lines, license, reduction, words_missing, words_added, block, nearest: a row for each block."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in slices(batches):
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in scanner.scan(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return id_text(docs).where(F.col("text").rlike(CUE)).mapInArrow(run, SCHEMA)
