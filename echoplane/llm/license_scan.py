"""License scans by patience alignment.

Words are lower-cased and freed of punctuation. A template's words that are no function
words are its signal. Wherever a stretch of a document a little longer than the template
holds so many different signal words that COVER of the template could be there, the
stretch is aligned: words unique to both sides are anchors, the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same
way, with equal words at their ends matched first. The share of the template's words that
are matched is its coverage; COVER or more is a find, and the scan goes on after it.

Before it is aligned, a stretch's longest common subsequence with the template is worked
out by bits, a few operations a word. Where it is k words short of COVER, no stretch that
begins within the next k words can be long enough, so those are passed over.

Each document is scanned in one pass by itself; nothing is shuffled, and the templates
are a few kilobytes.

Defined results for odd rows: null and empty texts hold no license; rows with equal ids
are scanned one by one; a text may hold a license several times, and several licenses
may share words; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, chunks

COVER = 0.8
SLACK = 1.2
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Function words.
FUNCTION_WORDS = frozenset("a an and any are as at be by for from in is it its of on or such that the this to under was with you your".encode().split())
#: Public license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails, at, back = [], [], []
    for k, v in enumerate(values):
        j = bisect_left(tails, v)
        tails[j : j + 1] = [v]
        at[j : j + 1] = [k]
        back.append(at[j - 1] if j else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two word lists, in order, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [pairs[k] for k in longest_increasing([y for _, y in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def common_words(words: list[bytes], bits: dict[bytes, int], n: int) -> int:
    """Length of the longest common subsequence with a template of n words, whose places are bits: the
    zeros of a row of the usual table's differences."""
    whole = row = (1 << n) - 1
    for w in words:
        if m := bits.get(w):
            u = row & m
            row = (row + u | row - u) & whole
    return n - row.bit_count()


class Scanner:
    def __init__(self, templates: dict[str, str], cover: float = COVER):
        self.cover, self.templates, self.of = cover, [], {}
        for name, text in templates.items():
            words = normal_words(text)
            signal = set(words) - FUNCTION_WORDS or set(words)
            # So many different signal words are there if cover of all words are.
            need = max(1, len(signal) - (len(words) - ceil(cover * len(words) - 1e-9)))
            for w in signal:
                self.of.setdefault(w, []).append(len(self.templates))
            bits: dict[bytes, int] = {}
            for k, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << k
            self.templates.append((name, words, need, ceil(cover * len(words) - 1e-9), bits))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, matched words, coverage) of each find, in word places."""
        words, of = normal_words(text), self.of
        hits: dict[int, list[int]] = {}
        for k in [k for k, w in enumerate(words) if w in of]:
            for t in of[words[k]]:
                hits.setdefault(t, []).append(k)
        out = []
        for t, places in hits.items():
            name, template, need, least, bits = self.templates[t]
            reach, seen, hi, after, wait = int(len(template) * SLACK) + 1, Counter(), 0, 0, 0
            for lo, start in enumerate(places):
                while hi < len(places) and places[hi] < start + reach:
                    seen[words[places[hi]]] += 1
                    hi += 1
                if len(seen) >= need and start >= max(after, wait):
                    short = least - common_words(words[max(after, start - len(template) // 2 - 1) : start + reach], bits, len(template))
                    wait = start + short
                    if short <= 0 and (found := self._align(words, template, start, reach, after)):
                        out.append((name, *found))
                        after = found[1]
                seen[words[start]] -= 1
                if not seen[words[start]]:
                    del seen[words[start]]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _align(self, words: list[bytes], template: list[bytes], start: int, reach: int, after: int) -> tuple[int, int, int, float] | None:
        """The template laid over the words from the signal word at start on, or a little before it."""
        lead = max((k for k, w in enumerate(template) if w == words[start]), default=0)
        first = max(after, start - min(lead, len(template) // 2) - 1)
        matched = patience(words[first : start + reach], template)
        coverage = len(matched) / len(template)
        if coverage < self.cover:
            return None
        return first + matched[0][0], first + matched[-1][0] + 1, len(matched), coverage


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """(doc_id, license, start, end, n_matched, coverage): each find, in word places."""
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, cover)
        for table in chunks(batches, 4 << 20):
            ids, finds = [], []
            for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()):
                for f in scanner.scan(t):
                    ids.append(i)
                    finds.append(f)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([f[k] for f in finds], t) for k, t in enumerate(kinds))], names=["doc_id", "license", "start", "end", "n_matched", "coverage"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, n_matched long, coverage double")


def op1(spark, sf_dir: str) -> DataFrame:
    """Every license found in documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(text: str | None, template: str, cover: float = COVER) -> bool:
    """Whether some stretch as long as the template has cover of its words in order; for tests."""
    w, t = normal_words(text), normal_words(template)
    reach = int(len(t) * SLACK) + 1
    for s in range(len(w)):
        row = [0] * (len(t) + 1)
        for x in w[s : s + reach]:
            new = [0]
            for j, y in enumerate(t):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        if row[-1] >= cover * len(t):
            return True
    return False
