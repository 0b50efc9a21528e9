"""Licence statements in texts, by comparison with templates.

Text and templates are normalised alike: letters in lower case, everything that is no letter or digit separates words,
"copyright ... year" at the start of a line is left out. Two word sequences are compared by the Dice coefficient of their
word bigrams with repetitions, ``2 |A and B| / (|A| + |B|)``. A passage is any window of words, over line ends or within a
line. For a threshold t only windows with between ``t / (2 - t)`` and ``(2 - t) / t`` times the bigrams of a template can reach
it, and they must share ``t / (2 - t)`` of its bigrams: templates and windows outside these bounds are never
compared. The best window begins and ends with a bigram of the template, since one that does not only gains by losing its
end, so only those are. A template of fewer than ``WHOLE`` bigrams must be met whole: a part of it names no licence.
For each template the best windows that do not overlap are kept; a finding within one of a template with ``TEXT`` bigrams and
twice its own is part of that one; of other findings that overlap the one with the highest coefficient stays (then the
longer, then by name). A template ``name#k`` is a further wording of ``name``, and reported as that.

Edge cases: null, empty and wordless texts hold nothing. Repeated rows are scanned each. Other columns are
ignored. Texts of any length are scanned whole; work per template is bounded by the size bounds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, texts_of
from .licence_texts import TEXTS

THRESHOLD = 0.8
WHOLE = 4
#: Bigrams from which a template is a text that may hold notices.
TEXT = 25
#: Cells of a matrix of windows that are worked on at once.
CELLS = 1 << 18

# Licence texts and notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}

_BSD2 = TEMPLATES["BSD-2-Clause"]
_GPL3 = TEMPLATES["GPL-3.0-header"]
TEMPLATES |= {
    "BSD-3-Clause": _BSD2.replace("THIS SOFTWARE IS PROVIDED BY", """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY"""),
    "GPL-2.0-header": _GPL3.replace("version 3", "version 2"),
    "AGPL-3.0-header": _GPL3.replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-header": _GPL3.replace("GNU General", "GNU Lesser General"),
    "LGPL-2.1-header": _GPL3.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 3", "version 2.1"),
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    **TEXTS,
}


def _names() -> dict[str, list[str]]:
    """How notices name a licence."""
    names = {
        "MIT": ["MIT License", "MIT licence", "Expat License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2"],
        "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPLv2"],
        "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause"],
        "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause"],
        "BSD": ["BSD License", "BSD licence"],
        "ISC": ["ISC License"],
        "Unlicense": ["Unlicense"],
        "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
    }
    for short, long in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License")):
        names[short] = [f"GNU {long}", long, f"GNU {short}", short, f"{short} License"]
        for version in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[short]:
            exact = version if "." in version else version + ".0"
            names[f"{short}-{exact}"] = [
                x for full in (f"GNU {long}", long, f"GNU {short}", short) for v in dict.fromkeys((version, exact)) for x in (f"{full} version {v}", f"{full} v{v}", f"{full} {v}", f"{full}v{v}")
            ]
    for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for version in ("3.0", "4.0"):
            names[f"CC-{code}-{version}"] = [f"CC {code} {version}", f"Creative Commons {words} {version}", f"Creative Commons {words} {version} International License"]
    return names


for _licence, _known_as in _names().items():
    _said = [lead + x for x in _known_as for lead in ("under the ", "under a ", "under ", "terms of the ", "license: ")] + [f"SPDX-License-Identifier: {_licence}"]
    for _k, _wording in enumerate(_said, 1):
        TEMPLATES[f"{_licence}-notice#{_k}"] = _wording

_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"\s*(?:copyright\b|\(c\)|©)[^\n]*?\b(?:19|20)\d\d\b(?:\s*[-–,]\s*(?:19|20)\d\d\b)*", re.I)


def normal_words(line: str) -> list[str]:
    return _WORD.findall(_COPYRIGHT.sub("", line, count=1).lower() if _COPYRIGHT.match(line) else line.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / max(1, a.total() + b.total())


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.grams = {name: Counter(bigrams(normal_words(" ".join(text.split("\n"))))) for name, text in templates.items()}
        self.size = {name: grams.total() for name, grams in self.grams.items()}
        self.of: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for name, grams in self.grams.items():
            for gram, times in grams.items():
                self.of.setdefault(gram, []).append((name, times))
        self.first_words = {gram[0] for gram in self.of}
        least = threshold / (2 - threshold)
        self.least = {name: least * n for name, n in self.size.items()}
        self.most = {name: n / least for name, n in self.size.items()}

    def _windows(self, name: str, places: dict[tuple[str, str], np.ndarray]) -> list[tuple[float, int, int]]:
        """(coefficient, first and last bigram) of the best windows of a template that do not overlap; ``places``: where each bigram stands."""
        size, least, most = self.size[name], self.least[name], self.most[name]
        grams = [gram for gram in self.grams[name] if gram in places]
        stand = np.concatenate([places[gram] for gram in grams])
        order = np.argsort(stand, kind="stable")
        at = stand[order]
        hit = np.empty(len(at), int)
        hit[order] = np.arange(len(at))
        # A bigram counts unless the template's number of it stands in the window before: ``full`` is the hit so many places back.
        full, first = np.full(len(at), -1), 0
        for gram in grams:
            own, times = hit[first : first + len(places[gram])], self.grams[name][gram]
            full[own[times:]] = own[:-times]
            first += len(own)
        found = []
        ends = np.searchsorted(at, at + most, side="right")  # windows of at most ``most`` bigrams, with room for rounding
        starts = np.flatnonzero(ends - np.arange(len(at)) >= least)
        width = int((ends[starts] - starts).max(initial=0))
        step = max(1, CELLS // max(1, width))
        for first in range(0, len(starts), step):  # many starts at once, a row each
            k = starts[first : first + step, None]
            places = k + np.arange(width)
            inside = places < ends[k]
            places = np.minimum(places, len(at) - 1)
            sizes = at[places] - at[k] + 1
            common = np.cumsum(inside & (full[places] < k), axis=1)
            score = np.where(inside & (sizes <= most) & (sizes >= least), 2 * common / (sizes + size), 0)
            if size < WHOLE:
                score[common < size] = 0
            best = score.argmax(1)
            top = score[np.arange(len(k)), best]
            for row in np.flatnonzero(top >= self.threshold):
                start = int(k[row, 0])
                found.append((float(top[row]), int(at[start]), int(at[start + best[row]])))
        return _apart(sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])), 1)

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, last line, template, coefficient) of the findings in a text, in order."""
        flat = [(w, i) for i, line in enumerate(text.split("\n")) for w in normal_words(line)]
        stand: dict[tuple[str, str], list[int]] = {}
        for k, ((a, _), (b, _)) in enumerate(zip(flat, flat[1:])):
            if a in self.first_words and (a, b) in self.of:
                stand.setdefault((a, b), []).append(k)
        shared: dict[str, int] = {}
        for gram, at in stand.items():
            n = len(at)
            for name, times in self.of[gram]:
                shared[name] = shared.get(name, 0) + (n if n < times else times)
        enough = [name for name, n in shared.items() if n >= self.least[name]]
        places = {gram: np.array(at) for gram, at in stand.items()} if enough else {}
        found = []
        for name in enough:
            found += [(-score, start - end, name.split("#")[0], start, end, self.size[name]) for score, start, end in self._windows(name, places)]
        # A notice within a licence text belongs to it.
        holders = _Holders(found)
        found = [x for x in found if not holders.hold(x)]
        taken = _apart(sorted(found), 3)
        return [(flat[start][1], flat[end + 1][1], name, -score) for score, _, name, start, end, _ in sorted(taken, key=lambda x: x[3])]


def _apart(found: list[tuple], start: int) -> list[tuple]:
    """The findings that share no word with one before them; ``start``: where a finding has its first and last bigram."""
    taken: list[tuple] = []
    starts: list[int] = []  # those taken share no word, so in their order the ends ascend as well
    ends: list[int] = []
    for x in found:
        before = bisect_right(starts, x[start + 1] + 1)
        if not before or ends[before - 1] + 1 < x[start]:
            taken.append(x)
            starts.insert(before, x[start])
            ends.insert(before, x[start + 1])
    return taken


class _Holders:
    """Findings of licence texts by size, each size by start with the furthest end so far: who holds a span needs one search a size."""

    def __init__(self, found: list[tuple]) -> None:
        self.by_size: dict[int, tuple[list[int], list[int]]] = {}
        for _, _, _, start, end, size in sorted((x for x in found if x[5] >= TEXT), key=lambda x: x[3]):
            starts, furthest = self.by_size.setdefault(size, ([], []))
            starts.append(start)
            furthest.append(max(end, furthest[-1]) if furthest else end)

    def hold(self, x: tuple) -> bool:
        for size, (starts, furthest) in self.by_size.items():
            if size >= 2 * x[5] and (k := bisect_right(starts, x[3])) and furthest[k - 1] >= x[4]:
                return True
        return False


def licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_line, last_line (from 0), licence and dice: one row per finding."""
    ship(docs.sparkSession)
    known = Templates(templates or TEMPLATES, threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(texts_of(batch)):
                for finding in known.find(text):
                    rows.append(row)
                    found.append(finding)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int32()))]
            for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64())):
                columns.append(pa.array([x[i] for x in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first_line", "last_line", "licence", "dice"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, first_line long, last_line long, licence string, dice double"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
