"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into words (A-Z lower-cased, punctuation dropped) and K-word shingles; winnowing keeps the least hash
of every WINDOW shingles in a row, and an inverted index lists the templates and places of each kept hash. Every shingle
of every text is looked up. From a hit on, the hits are one candidate whose diagonals (place in the text less place in
the template) differ by no more than the words that COVERAGE lets a match lose, or INSERTED lets it hold between its
parts (BAND words at least). The candidate is aligned with the template from BAND diagonals below to BAND above its hits:
the longest common subsequence of words there, with the fewest text words among the longest. A match covers at least
COVERAGE of the template's words and is reported with the span it takes in the text (code points, end exclusive). The
text before and after a match is searched again. Of templates of fewer than SHORT words every
shingle is kept, and shingles are so short that one is left whatever words COVERAGE lets a match change; such a notice
must keep the words of NAMED. Templates of fewer words than K, and tags, are matched whole, word by
word. Of overlapping matches of templates that are variants of one text, the one with the most words stays.

The index is bounded by the templates and sent with the tasks; texts are scanned whole, each on its own.

Defined results: a null or empty text has no match. A text with several licenses, or one license several times, has a
row for each. Repeated rows are scanned one by one. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.llm.words import BREAK, LOWER, Texts, hashes, mix, slices

K = 5
WINDOW = 4
BAND = 8
COVERAGE = 0.8
INSERTED = 0.5
SHORT = 20
SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, span_start long, span_end long"

# Notices and texts of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under
        the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation; either version 2 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Affero General Public License for more details.""",
    "GPL-2.0-preamble": """The licenses for most software are designed to take away your freedom to share and change it.
        By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free
        software--to make sure the software is free for all its users.""",
    "GPL-3.0-preamble": """The licenses for most software and other practical works are designed to take away your freedom
        to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom
        to share and change all versions of a program--to make sure it remains free software for all its users.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0-notice": "has waived all copyright and related or neighboring rights to",
    "CC0-1.0-deed": """The person who associated a work with this deed has dedicated the work to the public domain by
        waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring
        rights, to the extent allowed by law.""",
    "All-rights-reserved": "All rights reserved.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}
# One word tells these tags apart, so they are matched whole.
TAG = "SPDX-"
TEMPLATES |= {
    f"{TAG}{n}": f"SPDX-License-Identifier: {n}" for n in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
        "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    )
}
# Templates that share most of their words: of their matches in one place, the one with the most words is reported.
VARIANTS = (
    ("BSD-2-Clause", "BSD-3-Clause"),
    ("GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header"),
    ("GPL-2.0-preamble", "GPL-3.0-preamble"),
    ("CC-BY-4.0-notice", "CC-BY-SA-4.0-notice"),
)
# Words that a short notice may not lose: without them it is another license's.
NAMED = {
    "MIT-notice": "MIT", "Apache-2.0-notice": "Apache 2 0", "GPL-3.0-notice": "GNU General 3",
    "CC-BY-NC-4.0-notice": "CC BY NC 4 0", "CC-BY-4.0-notice": "Creative Commons Attribution 4 0",
    "CC-BY-SA-4.0-notice": "Creative Commons Attribution ShareAlike 4 0",
}


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, of = texts.words(BREAK)
    return starts, ends, of, hashes(LOWER[texts.data], starts, ends)


def shingles(h: np.ndarray, length: int = K) -> np.ndarray:
    """Hash of the ``length`` words from each word on; length - 1 fewer than words."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - length + 1]
    for k in range(1, length):
        out = mix(out) + h[k: len(h) - length + 1 + k]
    return out


def winnowed(values: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least value (rightmost of ties) of every ``window`` values in a row, or of all if fewer."""
    if not len(values):
        return []
    runs = max(1, len(values) - window + 1)
    kept = set()
    for k in range(runs):
        part = values[k: k + window]
        kept.add(k + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(kept)


def shingle_words(words: int) -> int:
    """Words of a shingle of a template of so many words; of a short one, what any words lost in a match leave in a row."""
    if words >= SHORT:
        return K
    kept = math.ceil(COVERAGE * words)
    return min(K, math.ceil(kept / (words - kept + 1)))


class Index:
    """Inverted index of the templates' fingerprints, one per shingle length."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        texts = Texts(pa.array([templates[n] for n in self.names], pa.string()))
        _, _, of, h = _words(texts)
        self.words = [h[of == k] for k in range(len(self.names))]
        named = Texts(pa.array([NAMED.get(n, "") for n in self.names], pa.string()))
        _, _, of, h = _words(named)
        self.named = [h[of == k] for k in range(len(self.names))]
        self.whole = [n.startswith(TAG) or len(w) < K for n, w in zip(self.names, self.words, strict=True)]
        rows: dict[int, list] = {}
        for k, words in enumerate(self.words):
            if not len(words):
                raise ValueError(f"template {self.names[k]} has no words")
            length = len(words) if self.whole[k] else shingle_words(len(words))
            s = shingles(words, length)
            rows.setdefault(length, []).extend((int(s[p]), k, p) for p in winnowed(s, WINDOW if length == K else 1))
        self.tables = {}
        for length, held in sorted(rows.items()):
            keys, template, place = zip(*sorted(held), strict=True)
            self.tables[length] = (
                np.array(keys, dtype=np.uint64), np.array(template, dtype=np.int64), np.array(place, dtype=np.int64)
            )

    def hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, template, place in template) of every equal fingerprint; ``h`` and ``of`` are the words of texts."""
        out = [np.zeros((3, 0), np.int64)]
        for length, (keys, template, place) in self.tables.items():
            values = shingles(h, length)
            lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
            found = np.flatnonzero(hi > lo)
            found = found[of[found] == of[found + length - 1]]
            count = hi[found] - lo[found]
            entry = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            out.append(np.stack([np.repeat(found, count), template[entry], place[entry]]))
        at, template, place = np.concatenate(out, axis=1)
        return at, template, place


def inserted(words: int) -> int:
    """How many words may stand between parts of a template of so many words."""
    return max(BAND, int(INSERTED * words))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched, first, last): longest common subsequence with text place - template place from ``low`` to ``high``.

    ``first`` and ``last`` are text places of its ends; of the longest the one that ends first, then starts last.
    """
    width = high - low + 1
    # best[d]: (matched, start) of alignments that end at or before text place i + d + low
    best = [(0, -1)] * width
    top, last = (0, -1), -1
    for i, word in enumerate(template.tolist()):
        row = []
        for d in range(width):
            j = i + low + d
            up = best[d + 1] if d + 1 < width else (0, -1)  # skip the template's word
            side = row[d - 1] if d else (0, -1)  # skip the text's word
            cell = max(up, side)
            if 0 <= j < len(text) and text[j] == word:
                n, start = best[d]
                cell = max(cell, (n + 1, start if n else j))
                if cell[0] > top[0]:
                    top, last = cell, j
            row.append(cell)
        best = row
    return top[0], top[1], last


def matches(
    words: np.ndarray, h: np.ndarray, at: np.ndarray, place: np.ndarray, lo: int, hi: int
) -> list[tuple[int, int, int]]:
    """(matched, first, last) of every match of a template in the words ``lo`` to ``hi`` (exclusive) of ``h``.

    ``at`` and ``place`` are the template's hits there, in text order. From each hit, the hits that a match can join with
    it are chained: as many words may be lost as COVERAGE allows, and as many inserted as ``inserted`` says. What a match
    leaves of the text on either side is searched again.
    """
    lost, more = len(words) - math.ceil(COVERAGE * len(words)), inserted(len(words))
    shift = at - place
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        k, end = int(np.searchsorted(at, lo)), int(np.searchsorted(at, hi))
        tried = (0, -1)
        while k < end:
            to = min(end, int(np.searchsorted(at, shift[k] + len(words) + more, side="right")))
            near = shift[k:to][(shift[k:to] >= shift[k] - lost) & (shift[k:to] <= shift[k] + more)]
            low, high = int(near.min()) - BAND, int(near.max()) + BAND
            k += 1
            if tried[0] <= low and high <= tried[1]:
                continue  # within a band that had no match
            begin, stop = max(lo, low), min(hi, high + len(words) + 1)
            text = h[begin:stop]
            tried = low, high
            if np.isin(words, text).sum() < COVERAGE * len(words):
                continue
            matched, a, b = align(words, text.tolist(), low - begin, high - begin)
            if matched < COVERAGE * len(words):
                continue
            out.append((matched, begin + a, begin + b))
            todo += [(lo, begin + a), (begin + b + 1, hi)]
            break
    return out


def distinguished(rows: list[tuple]) -> list[tuple]:
    """The rows without those of a variant that share words with a better match of another variant."""
    family = {name: k for k, names in enumerate(VARIANTS) for name in names}
    out, taken = [], {}
    for row in sorted(rows, key=lambda r: (-r[3], -r[2], r)):
        if row[1] in family:
            spans = taken.setdefault((row[0], family[row[1]]), [])
            k = bisect_left(spans, (row[5], row[6]))
            if k and spans[k - 1][1] > row[5] or k < len(spans) and spans[k][0] < row[6]:
                continue
            spans.insert(k, (row[5], row[6]))
        out.append(row)
    return out


def scan(index: Index, texts: Texts) -> list[tuple[int, str, float, int, int, int, int]]:
    """(text number, license, coverage, matched, template words, start, end) of every match."""
    starts, ends, of, h = _words(texts)
    at, template, place = index.hits(h, of)
    order = np.lexsort((place, at, template, of[at]))
    at, template, place = at[order], template[order], place[order]
    out = []
    counted, points = -1, None  # points: code points up to each byte of the text ``counted``
    change = np.flatnonzero((np.diff(of[at]) != 0) | (np.diff(template) != 0)) + 1
    for first, last in itertools.pairwise([0, *change.tolist(), len(at)] if len(at) else []):
        t, n = int(of[at[first]]), int(template[first])
        lo, hi = int(np.searchsorted(of, t)), int(np.searchsorted(of, t, side="right"))
        words = index.words[n]
        if index.whole[n]:
            found = [(len(words), int(a), int(a) + len(words) - 1) for a in at[first:last]]
        else:
            found = matches(words, h, at[first:last], place[first:last], lo, hi)
        for matched, a, b in found:
            if not np.isin(index.named[n], h[a: b + 1]).all():
                continue
            zero = texts.offsets[t]
            if t != counted:
                points, counted = np.cumsum((texts.data[zero: texts.offsets[t + 1]] & 0xC0) != 0x80), t
            # a word's first byte begins a code point, its last byte ends one
            span = [int(points[starts[a] - zero]) - 1, int(points[ends[b] - 1 - zero])]
            out.append((t, index.names[n], matched / len(words), matched, len(words), *span))
    return sorted(distinguished(out))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per license found in a text."""
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows = scan(index, texts)
            ids = batch.column(0).to_pylist()
            columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows], strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op6(docs: DataFrame) -> DataFrame:
    return scanned(docs)
