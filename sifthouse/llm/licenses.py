"""License scans by patience alignment of document words with license templates.

A template's words that occur once in it propose where in a document it may stand. In each such
region the words unique to both sides anchor the alignment: the longest increasing subsequence of
anchors is kept, and the gaps between anchors are aligned the same way, by the words unique within
the gap, until nothing is left to anchor; equal words next to an anchor extend it. The coverage is
the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_column, with_fields

# Notices, and license texts as their authors publish them. Names that end in -notice or -grant are of
# pieces that stand alone, those in -text of whole texts whose header has the plain name.
_GPL = (
    "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")
_AS_IS = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."),
    "GPL-2.0": _GPL.format(what="program", a=";", b=";", kind="", version="2"),
    "GPL-3.0": _GPL.format(what="program", a=":", b=",", kind="", version="3"),
    "LGPL-2.1": _GPL.format(what="library", a=";", b=";", kind="Lesser ", version="2.1"),
    "LGPL-3.0": _GPL.format(what="program", a=":", b=",", kind="Lesser ", version="3"),
    "AGPL-3.0": _GPL.format(what="program", a=":", b=",", kind="Affero ", version="3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES["MIT"] = TEMPLATES["MIT-grant"] + _AS_IS
TEMPLATES["ISC"] = TEMPLATES["ISC-grant"] + (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
TEMPLATES["BSD-3-Clause-grant"] = TEMPLATES["BSD-2-Clause-grant"] + (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.")
for _n in ("BSD-2-Clause", "BSD-3-Clause"):
    TEMPLATES[_n] = TEMPLATES[f"{_n}-grant"] + _BSD_END
TEMPLATES |= {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
# End of fixed values.

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII, in small letters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first places, whose second places increase."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing on both sides, by patience alignment."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


#: A template of fewer words must stand in a text without words between its own: scattered, a few common words name nothing.
SHORT = 12


def _unbroken(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest stretch of pairs that follow each other in both, the first of equals."""
    best, start = (0, 0), 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] != pairs[k - 1][0] + 1 or pairs[k][1] != pairs[k - 1][1] + 1:
            best = max(best, (k - start, -start))
            start = k
    return pairs[-best[1] : -best[1] + best[0]]


class Scanner:
    """Finds templates in word lists. A match aligns ``coverage`` of a template or more, within a span of up to twice its words."""

    def __init__(self, templates: dict[str, str], coverage: float = 0.8):
        self.coverage = coverage
        self.templates = [(name, words, Counter(words)) for name, words in ((n, words_of(t)) for n, t in sorted(templates.items())) if words]
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """``(template, coverage, first word, end)``, the best first.

        Of matches that align mostly the same words the best stays: the one of most words aligned, less those that its template or its span has besides.
        """
        shared = self.vocabulary.intersection(words)
        found = []
        if not shared:
            return found
        places: dict[bytes, list[int]] | None = None
        for name, template, count in self.templates:
            # the whole alignment can't cover more than the words present
            if sum(n for w, n in count.items() if w in shared) < self.coverage * len(template):
                continue
            if places is None:
                places = {}
                for i, w in enumerate(words):
                    if w in shared:
                        places.setdefault(w, []).append(i)
            found += self._match(name, template, count, words, places)
        score = lambda m: 3 * len(m[3]) - m[2] - (m[3][-1][0] + 1 - m[3][0][0])
        found.sort(key=lambda m: (-score(m), -len(m[3]), m[3][0], m[0]))
        used: set[int] = set()
        kept = []
        for name, cover, _, pairs in found:
            mine = {i for i, _ in pairs}
            if 2 * len(mine & used) <= len(mine):
                used |= mine
                kept.append((name, cover, pairs[0][0], pairs[-1][0] + 1))
        return kept

    def _match(self, name, template, count, words, places) -> Iterator[tuple[str, float, int, list[tuple[int, int]]]]:
        size = len(template)
        origins = sorted(at - i for i, w in enumerate(template) if count[w] == 1 for at in places.get(w, ()))
        slack = max(2, size // 4)
        # origins of one occurrence lie close together; a cluster needs the votes of half the unique words covered
        need = max(1, int(self.coverage * sum(1 for n in count.values() if n == 1)) // 2)

        def aligned(low: int, high: int) -> list[tuple[int, int]]:
            begin = max(low - slack, 0)
            pairs = [(begin + i, j) for i, j in align(words[begin : high + size + slack], template)]
            while pairs and pairs[-1][0] + 1 - pairs[0][0] > 2 * size:
                pairs = pairs[1:] if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
            if size < SHORT:
                pairs = _unbroken(pairs)
            return pairs if len(pairs) >= self.coverage * size else []

        clusters: list[tuple[int, int, int, list]] = []
        i = 0
        while i < len(origins):
            j = i
            while j + 1 < len(origins) and origins[j + 1] - origins[j] <= slack and origins[j + 1] - origins[i] <= size:
                j += 1
            clusters.append((origins[i], origins[j], j - i + 1, aligned(origins[i], origins[j]) if j - i + 1 >= need else []))
            i = j + 1
        # words put between parts of a template move the origins of the later parts by up to its size; a joined region holds one match at most
        i = 0
        while i < len(clusters):
            j, votes, best = i, clusters[i][2], clusters[i][3]
            while j + 1 < len(clusters) and clusters[j + 1][1] - clusters[i][0] <= size and not (best and clusters[j + 1][3]):
                j += 1
                votes, best = votes + clusters[j][2], best or clusters[j][3]
            if j > i and votes >= need and len(best) < size:
                wide = aligned(clusters[i][0], clusters[j][1])
                best = wide if len(wide) > len(best) else best
            if best:
                yield name, len(best) / size, size, best
            i += 1
            while best and i < len(clusters) and clusters[i][0] + size <= best[-1][0] + 1 + slack:
                i += 1


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: an array of ``(license, coverage, first, end)`` in order of place, over each whole text.

    Null and empty texts have no licenses; a text that names a license twice lists it twice.
    A match aligns ``coverage`` of a template within a span of up to twice its words; of a
    template of under ``SHORT`` words, without other words between.
    """
    base = docs.drop("n_words", "licenses")
    names = base.columns
    schema = with_fields(base, "n_words long, licenses array<struct<license:string,coverage:double,first:int,end:int>>")
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates if templates is not None else TEMPLATES))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, coverage)
        for batch in batches:
            counts, found = [], []
            for text in text_column(batch).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found.append([dict(zip(("license", "coverage", "first", "end"), m, strict=True)) for m in sorted(scanner.scan(words), key=lambda m: (m[2], m[0]))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(found, kind)], [*names, "n_words", "licenses"])

    return base.mapInArrow(run, schema)
