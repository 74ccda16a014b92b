"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Of every few neighbouring three-word grams of a template the one with the smallest hash goes into an inverted index, which is
sent to the tasks (its size is that of the templates, which are given). Every gram of a document is looked up. Hits of one
template on near diagonals are a candidate, and the template's words are aligned with that part of the document inside a
band; the alignment gives the share of the template that is there, and where.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import text_of
from basketflow.llm.decontaminate import _FOLD, words_of

GRAM = 3
#: Neighbouring grams of which one is kept: a common run of GRAM + WINDOW - 1 words is always found.
WINDOW = 2
#: Words that an alignment may drift from its diagonal.
BAND = 8
#: Words that a match of a longer template has at least; of a template with fewer words every word must be there, as in
#: "Licensed under CC BY-NC" each tells one licence from another.
LEAST_WORDS = 12

#: Identifiers of common public licences, as a line "SPDX-License-Identifier" names them.
IDENTIFIERS = (
    "Apache-2.0 MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC-BY-NC-ND-4.0 MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()

#: The Creative Commons licences with their conditions.
_COMMONS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")

#: Spellings that count as one word.
_SAME_WORDS = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}

#: Passages that several licences share.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole short licences, and the notices and headers by which works name the long ones.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. " + _AS_IS
    ),
    "MIT distribution notice": "Distributed under the MIT License",
    "MIT use notice": "Licensed under the MIT License",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + _BSD_THIRD + _BSD_END,
    "GPL notice": "This work is licensed under the GNU General Public License, version",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    **{f"CC {kind} notice": f"Licensed under CC {kind}" for kind in _COMMONS},
    "CC BY 4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring "
        "rights to this work."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    **{f"SPDX {name}": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS},
}

SCHEMA = "doc_id long, license string, coverage double, matched_words long, start long, end long"


class Index:
    """Template words as ids, and the winnowed grams of all templates with their places."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW) -> None:
        self.names = sorted(templates)
        self.gram = gram
        ids: dict[bytes, int] = {}
        self.words = [[ids.setdefault(_SAME_WORDS.get(w, w), len(ids) + 1) for w in words_of(templates[n])] for n in self.names]
        ids.update({w: ids[same] for w, same in _SAME_WORDS.items() if same in ids})
        self.ids = ids
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            size = min(gram, len(words))
            codes = [self._code(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []
            hashes = [xxhash.xxh3_64_intdigest(c.to_bytes(8, "little")) for c in codes]
            kept = set()
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                part = hashes[k : k + window]
                kept.add(k + max(j for j, h in enumerate(part) if h == min(part)))
            for k in sorted(kept):
                self.places[codes[k]].append((t, k))
        self.selected = np.array(sorted(self.places), np.int64)

    def _code(self, ids: list[int]) -> int:
        out = 0
        for k in range(self.gram):
            out = (out << 20) | (ids[k] if k < len(ids) else 0)
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in the document, place in the template) of each known gram of a document."""
        if len(ids) < self.gram or not len(self.selected):
            return []
        n = len(ids) - self.gram + 1
        codes = np.zeros(n, np.int64)
        for k in range(self.gram):
            codes = (codes << 20) | ids[k : k + n]
        at = np.flatnonzero(np.isin(codes, self.selected))
        return [(t, int(p), q) for p in at for t, q in self.places[int(codes[p])]]


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND) -> tuple[int, ...]:
    """Places in `words` that the best local alignment within `band` words of a diagonal matches, in order.

    A match counts 2, a mismatch or a left-out word -1. The diagonal is a word's place in the text less that in the template.
    """
    m, n = len(template), len(words)
    # Per band column: (score, matches, (last matched place, those before)); column c of row i is text place i + diagonal + c - band.
    empty = (0, 0, None)
    above = [empty] * (2 * band + 1)
    best = empty
    for i in range(m):
        row = [empty] * (2 * band + 1)
        for c in range(2 * band + 1):
            j = i + diagonal + c - band
            if not 0 <= j < n:
                continue
            s, k, at = above[c]
            if template[i] == words[j]:
                cell = (s + 2, k + 1, (j, at))
            else:
                cell = (s - 1, k, at) if s > 1 else empty
            for s, k, at in ((above[c + 1] if c < 2 * band else empty), (row[c - 1] if c else empty)):
                if s - 1 > cell[0]:
                    cell = (s - 1, k, at)
            row[c] = cell
            if cell[:2] > best[:2]:
                best = cell
        above = row
    places, at = [], best[2]
    while at:
        places.append(at[0])
        at = at[1]
    return tuple(places[::-1])


def _copies(template: list[int], hits: list[tuple[int, int]], listed: list[int], band: int, least: int) -> list[tuple[int, ...]]:
    """Matched places of each copy of one template, `least` of them or more; `hits` are (place in the document, diagonal).

    Copies share no word: each hit is aligned with the words between the copies before and after it that are known, so one
    of several copies within the band never stands for another.
    """
    taken: list[tuple[int, ...]] = []  # in order of their places
    failed: list[tuple[int, int]] = []
    for p, diagonal in sorted(hits):
        while True:
            after = bisect_right(taken, p, key=lambda x: x[0])
            floor = taken[after - 1][-1] + 1 if after else 0
            if p < floor or any(abs(diagonal - d) <= band and p < end for d, end in failed[-2 * band - 1 :]):
                break
            lo, hi = max(floor, diagonal - band), min(len(listed), diagonal + len(template) + band)
            if after < len(taken):
                hi = min(hi, taken[after][0])
            matched = align(template, listed[lo:hi], diagonal - lo, band)
            if len(matched) < least:
                failed.append((diagonal, lo + matched[-1] + 1 if matched else hi))
                break
            taken.insert(after, tuple(lo + j for j in matched))
    return taken


def _best_covered(found: list[tuple[int, tuple[int, ...]]], sizes: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Those of `found` (template, matched places) whose words are not for the most part matched by a better template there.

    Better is the one with more words there, of equal ones the shorter template, of which more is there. Templates that are
    equal in both stay: the text does not tell which is meant.
    """
    kept = []
    owner: dict[int, tuple[int, int]] = {}  # the best kept match at a place
    for t, places in sorted(found, key=lambda x: (-len(x[1]), sizes[x[0]])):
        own = len(places), -sizes[t]
        if 2 * sum(owner.get(j, own) > own for j in places) < len(places):
            kept.append((t, places))
            for j in places:
                owner.setdefault(j, own)
    return kept


def _matches(text: str, words: list[bytes], ids: np.ndarray, index: Index, band: int, least_coverage: float) -> list[tuple]:
    """(name, coverage, matched, start, end) of each template found, in code points, without repeats of one place."""
    by_template = defaultdict(list)
    for t, p, q in index.hits(ids):
        by_template[t].append((p, p - q))
    if not by_template:
        return []
    listed = ids.tolist()
    sizes = [len(x) for x in index.words]
    least = [max(min(n, LEAST_WORDS), math.ceil(least_coverage * n)) for n in sizes]
    found = _best_covered([(t, places) for t, hits in by_template.items() for places in _copies(index.words[t], hits, listed, band, least[t])], sizes)
    if not found:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    folded, starts, at = raw.translate(_FOLD), [], 0
    for w in words:
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)

    def place(byte: int) -> int:
        return len(raw[:byte].decode("utf-8", "surrogatepass"))

    rows = [(index.names[t], round(len(x) / len(index.words[t]), 6), len(x), place(starts[x[0]]), place(starts[x[-1]] + len(words[x[-1]]))) for t, x in found]
    return sorted(rows, key=lambda x: (x[3], x[4], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, least_coverage: float = 0.0) -> DataFrame:
    """One row per place in `docs` (doc_id, text; other columns are ignored) where a template's words are found.

    `coverage` is the share of the template's words that the alignment matches, at least `least_coverage`; a part of a
    template counts from LEAST_WORDS matched words on, a template with fewer words only as a whole. `start` and `end` are code
    points around the first and last matched word. Licence and license are one word. Copies in a row are a row each; where the words of one template lie for
    the most part among the words of a longer match, only that one is reported. Words are runs of letters and digits; case does not count. NULL and
    empty texts have no rows. Repeated rows are reported once each. Templates without words are never found.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = index.value.ids
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                words = words_of(text)
                known = np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))
                if known.any():
                    out += [(doc, *m) for m in _matches(text, words, known, index.value, band, least_coverage)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "license", "coverage", "matched_words", "start", "end")
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)
