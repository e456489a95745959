"""License scans by patience alignment."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.license_texts import TEXTS

_WORD = re.compile(r"[^\W_]+")

_GPL_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_GPL_HEAD = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_MIT_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Notices and whole texts of public licenses, as their stewards give them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD notice": "Released under the BSD License.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": f"{_BSD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "GPL-3.0 whole header": f"{_GPL_HEAD} {_GPL_TAIL}".format("", "3"),
    "GPL-2.0 header": _GPL_HEAD.format("", "2"),
    "GPL-2.0 whole header": f"{_GPL_HEAD} {_GPL_TAIL}".format("", "2"),
    "LGPL-3.0 header": f"{_GPL_HEAD} {_GPL_TAIL}".format("Lesser", "3"),
    "LGPL-2.1 header": f"{_GPL_HEAD} {_GPL_TAIL}".format("Lesser", "2.1"),
    "AGPL-3.0 header": f"{_GPL_HEAD} {_GPL_TAIL}".format("Affero", "3"),
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    **TEXTS,
}
TEMPLATES["MIT whole"] = f"{TEMPLATES['MIT']} {_MIT_TAIL}"
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in _CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_short}-{_version} mark"] = f"Licensed under CC {_short} {_version}."
        TEMPLATES[f"CC-{_short}-{_version} notice"] = f"This work is licensed under a Creative Commons {_long} {_version} {_port} License."
#: Words that tell licenses apart. A template of fewer than ``SHORT`` words only stands where all that it has of them are matched, and its numerals.
NAMING = frozenset("mit apache bsd gnu lesser affero creative cc by sa nc nd attribution sharealike noncommercial noderivatives mozilla".split())
SHORT = 20


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    found, i = [], piles[-1] if piles else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) places: equal ends, anchors, then the gaps between anchors in turn."""
    found, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if here[w] == 1}
        both = [(place[w], k) for k, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        anchors = [both[k] for k in longest_increasing([x for x, _ in both])]
        if not anchors:
            continue
        found += anchors
        for (x, y), (x2, y2) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            work.append((x + 1, x2, y + 1, y2))
    return sorted(found)


def windows(text: list[str], template: list[str], need: int) -> list[tuple[int, int, int]]:
    """(bound, first word, word after the last): windows of a template's length and half as much again that hold at least ``need`` of its words, by falling bound.

    A window can match no more of the template than the words both have, each as often as the rarer side
    has it, so no window that reaches ``need`` is left out. Windows begin at every word; those that
    begin within a sixteenth of the template's length are one, which holds them all.
    """
    n = len(template)
    hop, size = n // 16 + 1, n + n // 2
    best: dict[int, int] = {}
    left, held = Counter(template), 0
    for end in range(len(text) + size):
        if end < len(text) and (w := text[end]) in left:
            held += left[w] > 0
            left[w] -= 1
        start = end - size + 1
        if start > 0 and (w := text[start - 1]) in left:
            left[w] += 1
            held -= left[w] > 0
        if held >= need and start < len(text):
            k = max(0, start) // hop
            best[k] = max(best.get(k, 0), held)
    found = [(min(n, bound + hop - 1), k * hop, min(len(text), k * hop + hop - 1 + size)) for k, bound in best.items()]
    return sorted(found, key=lambda w: (-w[0], w[1]))


def _apart(found: list[tuple], span: Callable[[tuple], tuple[int, int]]) -> list[tuple]:
    """Of rows in order of preference those that share no more than half of their words with an earlier one that stays."""
    out: list[tuple] = []
    for row in found:
        a, b = span(row)
        if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for x, y in map(span, out)):
            out.append(row)
    return out


def places(text: list[str], template: list[str], need: int) -> list[tuple[int, int, int]]:
    """(matched words, first word, word after the last) of every place where at least ``need`` words of a template align, best first; places share no more than half of their words."""
    naming = {w for w in template if w in NAMING or w.isdigit()} if len(template) < SHORT else set()
    found: list[tuple[int, int, int]] = []
    for bound, a, b in windows(text, template, need):
        # A window around half of a place that already matches as many words can only show that place again.
        if any(m >= bound and 2 * (min(b, y) - max(a, x)) >= y - x for m, x, y in found):
            continue
        pairs = align(text[a:b], template)
        if len(pairs) >= need and naming <= {template[j] for _, j in pairs}:
            found.append((len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1))
    return _apart(sorted(set(found), key=lambda p: (-p[0], p[2] - p[1], p[1])), lambda p: p[1:])


def scan_text(text: str, templates: dict[str, list[str]], least: float, index: dict[str, list[tuple[str, int]]] | None = None) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, first line, line after the last) of every place, in order.

    A place is a window of up to one and a half template lengths of the word sequence, regardless of lines, that aligns with at
    least ``least`` of the template's words. Where places of several templates share over half of
    their words, the one that matches most words stays, then the one of the highest coverage: a
    longer or more exact template wins over those that it contains or nearly equals.
    """
    flat = words_of(text)
    found = []
    for name in _possible(flat, templates, least, index):
        template = templates[name]
        found += [(name, m / len(template), m, a, b) for m, a, b in places(flat, template, _need(template, least))]
    if not found:
        return []
    line_of = [k for k, line in enumerate(text.split("\n")) for _ in words_of(line)]
    found.sort(key=lambda p: (-p[2], -p[1], p[4] - p[3], p[3], p[0]))
    best = _apart(found, lambda p: p[3:])
    return [(name, share, m, line_of[a], line_of[b - 1] + 1) for name, share, m, a, b in sorted(best, key=lambda p: (p[3], p[0]))]


def _need(template: list[str], least: float) -> int:
    return max(1, math.ceil(least * len(template) - 1e-9))


def _possible(text: list[str], templates: dict[str, list[str]], least: float, index: dict[str, list[tuple[str, int]]] | None = None) -> list[str]:
    """Templates of which the text has enough words, each as often as the rarer side has it; an exact bound on what any place can match."""
    index = index_of(templates) if index is None else index
    shared = Counter(w for w in text if w in index)
    held: Counter = Counter()
    for w, k in shared.items():
        for name, n in index[w]:
            held[name] += min(k, n)
    return [name for name, template in templates.items() if held[name] >= _need(template, least)]


def index_of(templates: dict[str, list[str]]) -> dict[str, list[tuple[str, int]]]:
    """Templates and how often they have it, by word."""
    index: dict[str, list[tuple[str, int]]] = {}
    for name, words in templates.items():
        for w, n in Counter(words).items():
            index.setdefault(w, []).append((name, n))
    return index


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75) -> DataFrame:
    """doc_id, license, coverage, n_matched, first_line and end_line of every place of a license in every document (``scan_text``).

    Null and empty texts give nothing; repeated rows give repeated results; a null doc_id stays null. Texts of any
    length are read whole. An empty table gives no rows; other columns are not read. A row is judged by
    itself, so nothing is shuffled.
    """
    own = {k: words_of(v) for k, v in (templates or TEMPLATES).items()}
    index = index_of(own)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, *hit) for i, t in zip(frame["doc_id"].astype("Int64").tolist(), frame["text"], strict=True) for hit in scan_text(t, own, least, index)]
            frame = pd.DataFrame(out, columns=["doc_id", "license", "coverage", "n_matched", "first_line", "end_line"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(dtype=object))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id long, license string, coverage double, n_matched long, first_line long, end_line long")
