"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates become 5-word shingles. A template of fewer words is looked up by the hash of its whole
sequence among all runs of as many words of the text, so it is found anywhere and never missed.
Templates fall into classes by size: the class's step is the power of two not below the number of
shingles (``LEAST_STEP`` at least), and its windows are two steps long, one step apart, so a template lies
whole in some window. A window holding 80 % of a template of over half a step has a Jaccard
similarity to it of at least 0.8/4.2; with ``BANDS`` bands of one minimum each, it is retrieved with
probability 1 - (1 - J)^BANDS, over 1 - 1e-10. A template of one shingle has J = 1/8, missed with
probability 4e-8. Minima of a step's shingles are shared by both windows over it and by larger classes.
A band's slot names the templates that have it, so a window retrieves templates, however many there are; each
is verified on full shingle sets, so there are no false matches.

The templates are fixed, or given by the caller as a small dictionary; they are shipped with the code.

Defined cases: null or empty text matches nothing; a text of fewer words than a shingle can match only
templates of as few words; a template without words matches nothing; rows are judged one by one; other columns pass through (see
``columns`` for names that clash); an empty
table gives an empty table; no templates give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loquat.llm.columns import Carried
from loquat.llm.text import Words, alphabet, encode, lean, multipliers

SIZE, PERCENT, BANDS, LEAST_STEP = 5, 80, 128, 4
INSIDE = alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_CONTRIBUTORS_LIABLE = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_AUTHOR_DISCLAIMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Public licence texts and notices.
TEMPLATES = {
    "0BSD-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR_DISCLAIMS,
    "BSD-2-Clause-full": _TWO_CLAUSES + _CONTRIBUTORS_LIABLE,
    "BSD-3-Clause-full": _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _CONTRIBUTORS_LIABLE,
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR_DISCLAIMS,
    "MIT-full": _GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
    "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
    "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
    "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-text": _GRANT + ", subject to the following conditions",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "rights-reserved": "All rights reserved",
}
_KS = multipliers(BANDS, 51).astype(np.uint32) | np.uint32(1)


def runs(words: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, runs of each text)"""
    start, per_text = words.window_starts(size)
    return words.runs(start, size, 52), per_text


class Templates:
    """Shingle sets by class, with tables of their minima; ``short``: hash and name of those under a shingle, by words.

    By class, ``tables`` tell which slots of a band any template has, and ``slots`` which templates."""

    def __init__(self, texts: dict[str, str]):
        self.by_step: dict[int, list[tuple[str, np.ndarray]]] = {}
        self.short: dict[int, list[tuple[np.uint64, str]]] = {}
        for name, text in sorted(texts.items()):
            words = Words.of([encode(text)], INSIDE, lower=True)
            n = int(words.counts[0])
            if 0 < n < SIZE:
                self.short.setdefault(n, []).append((runs(words, n)[0][0], name))
            elif n:
                members = np.unique(runs(words)[0])
                step = max(LEAST_STEP, 1 << (len(members) - 1).bit_length())
                self.by_step.setdefault(step, []).append((name, members))
        self.tables, self.slots = {}, {}
        for step, held in self.by_step.items():
            table, slots = np.zeros((BANDS, 1 << 16), bool), {}
            for number, (_, members) in enumerate(held):
                own = _slot(np.multiply.outer(_KS, _key(members)).min(axis=1))
                table[np.arange(BANDS), own] = True
                for band, slot in enumerate(own.tolist()):
                    slots.setdefault((band, slot), []).append(number)
            self.tables[step], self.slots[step] = table, slots

    def find(self, texts: list[str | None]) -> tuple[list[list[tuple[str, int, int]]], np.ndarray]:
        """For each text: (template, first shingle of the window, shingles of the template found in it); and its words.

        A template under a shingle: (template, its first word, 1), once an occurrence."""
        words = Words.of([encode(x) for x in texts], INSIDE, lower=True)
        n_words = words.counts
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for size, held in self.short.items():
            hashes, per_text = runs(words, size)
            ends = np.cumsum(per_text)
            for key, name in held:
                for at in np.flatnonzero(hashes == key):
                    text = np.searchsorted(ends, at, side="right")
                    found[text].append((name, int(at - ends[text] + per_text[text]), 1))
        hashes, per_text = runs(words)
        if not len(hashes) or not self.by_step:
            return found, n_words
        # Steps of the least class, aligned to each text's begin.
        first = np.cumsum(per_text) - per_text
        steps = -(-per_text // LEAST_STEP)
        owner = np.repeat(np.arange(len(texts)), steps)
        number = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        at = first[owner] + number * LEAST_STEP
        keys = _key(hashes)
        least = np.empty((BANDS, len(at)), np.uint32)
        for k in range(BANDS):
            np.minimum.reduceat(keys * _KS[k], at, out=least[k])
        step = LEAST_STEP
        while True:
            if step in self.by_step:
                self._verify(step, least, owner, number, hashes, first, per_text, found)
            if step >= max(self.by_step):
                return found, n_words
            pair = np.flatnonzero(number % 2 == 0)  # two steps make one of the next class
            least = np.minimum.reduceat(least, pair, axis=1)
            owner, number, step = owner[pair], number[pair] // 2, step * 2

    def _verify(self, step, least, owner, number, hashes, first, per_text, found) -> None:
        table, slots, bands = self.tables[step], self.slots[step], np.arange(BANDS)
        last = np.r_[owner[1:] != owner[:-1], True]
        hit = np.zeros(len(owner), bool)
        for k in range(BANDS):
            window = least[k].copy()
            np.minimum(window[:-1], least[k][1:], out=window[:-1], where=~last[:-1])
            hit |= table[k][_slot(window)]
        for w in np.flatnonzero(hit):
            own = _slot(least[:, w] if last[w] else np.minimum(least[:, w], least[:, w + 1]))
            retrieved = {number for band in np.flatnonzero(table[bands, own]).tolist() for number in slots[band, int(own[band])]}
            text, begin = owner[w], int(number[w]) * step
            end = min(begin + 2 * step, per_text[text])
            inside = np.unique(hashes[first[text] + begin : first[text] + end])
            for name, members in (self.by_step[step][number] for number in sorted(retrieved)):
                common = int(np.isin(members, inside, assume_unique=True).sum())
                if 100 * common >= PERCENT * len(members):
                    found[text].append((name, begin, common))


def _key(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _slot(least: np.ndarray) -> np.ndarray:
    """Minima are small numbers: their bits are mixed before they number a slot."""
    return (least * np.uint32(0x9E3779B1)) >> np.uint32(16)


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``df``'s columns and ``_n_words`` (words), ``_licenses`` (sorted names of matching templates) and
    ``_matches`` (template, first word of a window holding it, shingles of it found there; 1 for a template under a shingle)."""
    carried = Carried(df)
    df, text = carried.df, carried(text)
    match = T.StructType([T.StructField("template", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("shingles", T.LongType())])
    added = [("_n_words", T.LongType()), ("_licenses", T.ArrayType(T.StringType())), ("_matches", T.ArrayType(match))]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    texts = dict(TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("shingles", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                found, n = known.find(batch.column(text).to_pylist())
                names = pa.array([sorted({m[0] for m in x}) for x in found], pa.list_(pa.string()))
                rows = pa.array([[dict(zip(("template", "first_word", "shingles"), m, strict=True)) for m in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), names, rows], names=[*batch.schema.names, "_n_words", "_licenses", "_matches"])

    return carried.back(df.mapInArrow(lean(run), schema), *(n for n, _ in added))
