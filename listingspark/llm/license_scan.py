"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is read as words of letters and digits, A-Z lower-cased, so line breaks and comment marks between words do not
count. Its windows of consecutive words, wherever they begin and end, are compared with the templates: each as the set of
its word bigrams. The coefficient 2|A and B| / (|A| + |B|) reaches the threshold t only if A and B share t / (2 - t) of
the template's bigrams, and the window has no more than (2 - t) / t as many as the template. The first bound, counted for
all templates and many texts at once, leaves few templates to a text; the second ends each window's growth. Only windows
whose first and last bigram are the template's and occur once in them are looked at: every other window has the set of
such a one, or a worse coefficient. So nothing that reaches the threshold is missed. Statements and notices that differ
only in the licence's name count only where that name stands in the window.

Defined cases: null and blank texts have no licence; a text of one word has no bigram; equal coefficients go to the
first licence by name, then to the earliest of those windows and the shortest; of windows that overlap, the better one counts; very
long texts are read whole, one at a time; equal texts get equal results; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import hashed_words, mix, own_columns, text_chunks

THRESHOLD = 0.8

# Licences by SPDX identifier, and how statements name them.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
STATEMENTS = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}",
    "This software is licensed under the {}", "This file is licensed under the {}", "This program is distributed under the terms of the {}",
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the "
    "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
)
GNU = (
    ("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3),
    ("LGPL-3.0", "GNU Lesser General Public License", 3), ("AGPL-3.0", "GNU Affero General Public License", 3),
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission."
)
BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License."
    ),
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL,
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


@dataclass(frozen=True)
class Template:
    licence: str
    text: str
    #: What a window must hold whole, besides reaching the threshold.
    name: str = ""


def templates() -> list[Template]:
    """Whole texts and notices, each statement with each name, and identifiers."""
    made = [Template(licence, text) for licence, text in TEXTS.items()]
    made += [Template(licence, GNU_NOTICE.format(name, version, name), f"{name} version {version}") for licence, name, version in GNU]
    made += [Template(licence, form.format(name), name) for licence, names in NAMES.items() for name in names for form in STATEMENTS]
    return made + [Template(licence, f"SPDX-License-Identifier: {licence}", f"Identifier: {licence}") for licence in NAMES]


def _bigrams(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words, _ = hashed_words(data, np.array([0, len(data)]), plain=True)
    return np.unique(_pairs(words))


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]


@dataclass(frozen=True)
class Known:
    """Templates ready for the scan: which bigrams there are, and which templates have each."""

    licences: list[str]
    sizes: np.ndarray
    vocabulary: np.ndarray
    #: By template: its bigrams as places in the vocabulary, and those of its name.
    sets: list[np.ndarray]
    musts: list[np.ndarray]
    #: By bigram: its templates, one after the other.
    begins: np.ndarray
    members: np.ndarray

    @classmethod
    def of(cls, made: Sequence[Template]) -> Known:
        whole = [(t, _bigrams(t.text)) for t in made]
        whole = [(t, grams) for t, grams in whole if len(grams)]
        vocabulary = np.unique(np.concatenate([grams for _, grams in whole])) if whole else np.zeros(0, np.uint64)
        sets = [np.searchsorted(vocabulary, grams) for _, grams in whole]
        musts = [np.searchsorted(vocabulary, np.intersect1d(_bigrams(t.name), grams)) for t, grams in whole]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        begins = np.searchsorted(flat[order], np.arange(len(vocabulary) + 1))
        return cls([t.licence for t, _ in whole], sizes, vocabulary, sets, musts, begins, np.repeat(np.arange(len(sets)), sizes)[order])

    def candidates(self, owner: np.ndarray, spot: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Texts and templates of which the text has enough different bigrams, from the text and bigram of each hit."""
        seen = np.unique(owner * len(self.vocabulary) + spot)
        owner, spot = np.divmod(seen, len(self.vocabulary))
        many = self.begins[spot + 1] - self.begins[spot]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begins[spot], many)
        pairs, shared = np.unique(np.repeat(owner, many) * len(self.sets) + self.members[at], return_counts=True)
        texts, chosen = np.divmod(pairs, len(self.sets))
        enough = shared >= self.sizes[chosen] * least - 1e-9
        return texts[enough], chosen[enough]


@lru_cache(1)
def _own_templates() -> Known:
    return Known.of(templates())


@dataclass(frozen=True, order=True)
class Window:
    """Words ``first`` to ``last`` of a text, ordered from the best match to the worst."""

    minus_dice: float
    licence: str
    first: int
    last: int


def _neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element, where the same value stands before it (-1) and behind it (the length)."""
    size = len(values)
    order = np.argsort(values, kind="stable")
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    before, behind = np.full(size, -1), np.full(size, size)
    before[order[same + 1]] = order[same]
    behind[order[same]] = order[same + 1]
    return before, behind


def _windows(spots: np.ndarray, before: np.ndarray, behind: np.ndarray, known: Known, k: int, threshold: float) -> Iterator[Window]:
    """The best window of template ``k`` from each bigram on, if it reaches the threshold."""
    size = int(known.sizes[k])
    need = int(np.ceil(size * threshold / (2 - threshold) - 1e-9))
    most = int(size * (2 - threshold) / threshold + 1e-9)
    places = np.flatnonzero(np.isin(spots, known.sets[k]))
    musts = [places[spots[places] == m] for m in known.musts[k]]
    if not all(len(m) for m in musts):
        return
    ends = np.searchsorted(places, behind[places])
    for s in np.flatnonzero(ends - np.arange(len(places)) >= need):
        first = places[s]
        bound = places[ends[s] - 1] + 1
        step = 4 * most + 16
        while True:  # different bigrams from here on, until they are too many
            different = np.cumsum(before[first : min(bound, first + step)] < first)
            if first + step >= bound or different[-1] > most:
                break
            step *= 4
        behind_last = first + np.searchsorted(different, most, side="right")
        inner = places[s : np.searchsorted(places, behind_last)]
        shared = np.cumsum(before[inner] < first)
        if not len(shared) or shared[-1] < need:
            continue
        later = [np.searchsorted(m, first) for m in musts]
        if any(i == len(m) for i, m in zip(later, musts, strict=True)):
            return  # no later window has the name either
        whole = max((m[i] for i, m in zip(later, musts, strict=True)), default=first)
        dice = np.where(inner >= whole, 2 * shared / (different[inner - first] + size), 0.0)
        best = int(np.argmax(dice))
        if dice[best] >= threshold - 1e-12:
            yield Window(-float(dice[best]), known.licences[k], int(first), int(inner[best]) + 1)


def scan(texts: pa.Array, threshold: float = THRESHOLD, known: Known | None = None) -> Iterator[list[dict]]:
    """For each text, the windows that are licences, best first; none overlaps a better one."""
    known = known or _own_templates()
    if not len(known.sets):
        yield from ([] for _ in texts)
        return
    for first, behind, data, offsets in text_chunks(texts):
        words, begins, starts = hashed_words(data, offsets, plain=True, places=True)
        grams = _pairs(words)
        spots = np.minimum(np.searchsorted(known.vocabulary, grams), len(known.vocabulary) - 1)
        spots = np.where(known.vocabulary[spots] == grams, spots, -1)
        inner = begins[(begins > 0) & (begins < len(words))]
        spots[inner - 1] = -1  # a pair of two texts' words
        hits = np.flatnonzero(spots >= 0)
        owner = np.searchsorted(begins, hits, side="right") - 1
        found: dict[int, list[Window]] = {}
        of_text, chosen = known.candidates(owner, spots[hits], threshold / (2 - threshold))
        for i in np.unique(of_text).tolist():
            low, high = begins[i], begins[i + 1] - 1
            own = _neighbours(grams[low:high])
            made = [w for k in chosen[of_text == i].tolist() for w in _windows(spots[low:high], *own, known, k, threshold)]
            if made:
                found[i] = _apart(made, int(high - low) + 1)
        for i in range(behind - first):
            base = offsets[i] - offsets[0]
            text = lambda i=i: data[offsets[i] : offsets[i + 1]].tobytes()
            yield _described(found[i], text(), starts[begins[i] : begins[i + 1]] - base) if i in found else []


def _apart(windows: list[Window], size: int) -> list[Window]:
    """From the best on, each window that shares no word with one taken before."""
    taken = np.zeros(size, dtype=bool)
    kept = []
    for w in sorted(windows):
        if not taken[w.first : w.last + 1].any():
            taken[w.first : w.last + 1] = True
            kept.append(w)
    return kept


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _described(windows: list[Window], text: bytes, starts: np.ndarray) -> list[dict]:
    end = lambda w: _WORD.match(text, int(starts[w.last])).end()
    return [{"licence": w.licence, "dice": -w.minus_dice, "at_byte": int(starts[w.first]), "end_byte": end(w)} for w in windows]


_PLACE = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("at_byte", pa.int64()), ("end_byte", pa.int64())])


def licensed(docs: DataFrame, threshold: float = THRESHOLD, more: Sequence[Template] = ()) -> DataFrame:
    """``doc_id``, the best ``licence``, its ``dice`` and ``at_byte``, the number of ``units`` found, and all of them as ``places``.

    ``more`` adds templates to the library's own, such as full texts of long licences.
    """
    known = Known.of([*templates(), *more]) if more else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(scan(batch.column(1), threshold, known))
            first = [f[0] if f else {"licence": None, "dice": 0.0, "at_byte": None} for f in found]
            columns = [pa.array([f[c] for f in first], kind) for c, kind in (("licence", pa.string()), ("dice", pa.float64()), ("at_byte", pa.int64()))]
            columns += [pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(_PLACE))]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "licence", "dice", "at_byte", "units", "places"])

    place = "struct<licence: string, dice: double, at_byte: bigint, end_byte: bigint>"
    return own_columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id bigint, licence string, dice double, at_byte bigint, units bigint, places array<{place}>")
