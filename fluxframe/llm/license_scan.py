"""License scans by patience alignment with templates.

A template is laid over a text wherever enough of its telling words vote for about the same place. There, words unique to both sides anchor the
alignment: the longest increasing subsequence of the anchors' places is kept, and the gaps between them are aligned the
same way, after common beginnings and ends are taken off. Coverage is the share of aligned words in the template or in the
span of the text that they take, whichever is longer, so that words left out and words put in both count; the words that tell
a licence from others must be aligned.
A text is looked at once, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: Whole public licence texts, a file named after each identifier.
WHOLE = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
# Public notices by their identifiers; several texts may share one.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
TEMPLATES = NOTICES + WHOLE
#: What tells a licence from others, for those of its templates that hold it: name and version, as neighbouring words of
#: which those with ? may lack, and clauses, which the coverage holds for.
NAMES = {
    "MIT": ("mit license?",), "Apache-2.0": ("apache license version? 2.0", "apache org licenses license 2.0"), "GPL-3.0": ("gnu general public license", "version 3"), "GPL-2.0": ("gnu general public license", "version 2"),
    "CC-BY-NC-4.0": ("cc by nc 4.0",), "CC-BY-4.0": ("cc by 4.0",), "CC-BY-SA-4.0": ("cc by sa 4.0",),
}
CLAUSES = {
    "MIT": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "BSD-3-Clause": ("nor the names of its contributors may be used to endorse or promote products derived from this software",),
    "ISC": ("provided that the above copyright notice and this permission notice appear in all copies",),
}
#: Words too common to tell a notice.
COMMON = frozenset("a an and any are as at by for in is it of on or that the this to under use with without you".split())
COVERAGE = 0.8
#: Words from which on a template is a whole text: its name is then told by its title.
LONG = 250
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
        before[i] = piles[p - 1] if p else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i, j), increasing in both, of equal words a[i] and b[j]."""
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
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors and i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


@dataclass
class Template:
    name: str
    text: str
    words: list[str] = field(init=False)
    marks: frozenset[str] = field(init=False)
    places: dict[str, list[int]] = field(init=False)
    names: list[tuple[int, list[str]]] = field(init=False)
    clauses: list[range] = field(init=False)

    def __post_init__(self) -> None:
        self.words = [m[0].lower() for m in _WORD.finditer(self.text)]
        self.marks = frozenset(self.words) - COMMON
        self.places = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.names = [(i, p.split()) for p in NAMES.get(self.name, ()) for i in self._where(p)[: 1 if len(self.words) > LONG else None]]
        self.told_by: dict[float, tuple[list[str], int, int]] = {}
        self.clauses = [range(i, i + len(p.split())) for p in CLAUSES.get(self.name, ()) for i in self._where(p)]

    def _where(self, phrase: str) -> list[int]:
        words = phrase.replace("?", "").split()
        return [i for i in range(len(self.words)) if self.words[i : i + len(words)] == words]

    def told(self, pairs: list[tuple[int, int]], coverage: float) -> bool:
        """The alignment holds the names and clauses that tell the licence from others."""
        to = dict(pairs)
        for i, phrase in self.names:
            spots = [to.get(i + k) for k in range(len(phrase))]
            held = [x for x in spots if x is not None]
            if any(x is None and not w.endswith("?") for w, x in zip(phrase, spots, strict=True)) or held != list(range(held[0], held[0] + len(held))):
                return False
        return all(sum(k in to for k in clause) >= coverage * len(clause) for clause in self.clauses)

    def telling(self, coverage: float) -> tuple[list[str], int, int]:
        """(words, need, spare): a text that reaches the coverage lacks spare places of the template at most, so it holds need places of words.

        words are the marks, or all words where the common ones alone could reach the coverage.
        """
        if coverage in self.told_by:
            return self.told_by[coverage]
        least = ceil(coverage * len(self.words) - 1e-9)
        words = sorted(self.marks)
        need = least - len(self.words) + sum(len(self.places[w]) for w in words)
        if need < 1:
            words, need = sorted(self.places), max(least, 1)
        self.told_by[coverage] = words, need, len(self.words) - least
        return self.told_by[coverage]

    def hints(self, coverage: float) -> frozenset[str]:
        """Words of which every text that reaches the coverage holds one: the longest, of more places than it may lack; of a whole text with a name, the name's first word."""
        if self.names and len(self.words) > LONG:
            return frozenset(self.names[0][1][:1])
        words, _, spare = self.telling(coverage)
        out, left = set(), spare
        for w in sorted(words, key=lambda w: (-len(w), w)):
            if left < 0:
                break
            out.add(w)
            left -= len(self.places[w])
        return frozenset(out)


def hints(templates: list[Template], coverage: float) -> tuple[str, ...]:
    """A text without any of these as a part holds no notice of the templates; those that hold another are left out."""
    every = frozenset().union(*(t.hints(coverage) for t in templates))
    return tuple(sorted(w for w in every if not any(v != w and v in w for v in every)))


def placements(at: dict[str, list[int]], t: Template, coverage: float, slack: int) -> list[int]:
    """Places in the text where the template may begin, those of most votes first.

    An occurrence of a telling word votes for the place that it gives the template. In an alignment that reaches the
    coverage within slack words of a place, votes are spare words farther away at most.
    """
    words, need, spare = t.telling(coverage)
    if sum(len(t.places[w]) for w in words if w in at) < need:
        return []
    votes = Counter(p - q for w in words for p in at.get(w, ()) for q in t.places[w])
    order = sorted(votes)
    upto = [0]
    for d in order:
        upto.append(upto[-1] + votes[d])
    near = slack + spare
    good = [d for d in order if upto[bisect_right(order, d + near)] - upto[bisect_left(order, d - near)] >= need]
    return sorted(good, key=lambda d: (-votes[d], d))


def covered(pairs: list[tuple[int, int]], size: int) -> float:
    """Aligned words as a share of the template's size, or of the text that they span where that is longer."""
    return len(pairs) / max(size, pairs[-1][1] - pairs[0][1] + 1) if pairs else 0.0


def trim(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """pairs without those at either end that stand apart: words of the text around that a template happens to have too."""
    a, b = 0, len(pairs)
    while b - a > 1 and (pairs[b - 1][1] - pairs[a][1] + 1) > size:
        head, tail = pairs[a + 1][1] - pairs[a][1], pairs[b - 1][1] - pairs[b - 2][1]
        if max(head, tail) <= max(4, size // 10):
            break
        if head >= tail:
            a += 1
        else:
            b -= 1
    return pairs[a:b]


def scan(text: str, templates: list[Template], coverage: float = COVERAGE, known: tuple[str, ...] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, name, coverage) of every notice found, in code points; of overlapping ones the best covered, then that of most words.

    known are the hints of the templates, where the caller has them.
    """
    low = text.lower()
    if not any(h in low for h in (hints(templates, coverage) if known is None else known)):
        return []
    found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    words = [w for _, _, w in found]
    at: dict[str, list[int]] = {}
    marks = frozenset().union(*(t.places for t in templates))
    for i, w in enumerate(words):
        if w in marks:
            at.setdefault(w, []).append(i)
    hits = []
    for t in templates:
        size = len(t.words)
        slack = size // 4 + 2
        whole: list[int] = []
        for d in placements(at, t, coverage, slack):
            if any(abs(d - x) <= slack for x in whole):  # it could only find the whole notice there again
                continue
            if size > LONG:  # a whole text begins once within its quarter, and the alignment sees as far
                whole.append(d)
            best = (0.0, 0, 0, 0)
            for room in (slack, 0):  # without room around, no word nearby can take the place of one of a whole notice
                lo, hi = max(0, d - room), min(len(words), max(d, 0) + size + room)
                pairs = trim(align(t.words, words[lo:hi]), size)
                if covered(pairs, size) >= (max(coverage, best[0] + 1e-9) if room else 1) and t.told(pairs, coverage):
                    best = covered(pairs, size), len(pairs), lo + pairs[0][1], lo + pairs[-1][1]
                if size > LONG:
                    break
            share, n, first, last = best
            if n:
                hits.append((share, n, found[first][0], found[last][1], t.name))
                if n == size and last - first == size - 1:
                    whole.append(first)
    out: list[tuple[int, int, str, float]] = []
    for share, _, s, e, name in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[4])):
        if all(e <= s2 or s >= e2 for s2, e2, _, _ in out):
            out.append((s, e, name, share))
    return sorted(out)


def _scan(pairs: tuple, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [Template(*p) for p in pairs]
        known = hints(templates, coverage)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = [[dict(zip(("start", "end", "license", "coverage"), h, strict=True)) for h in scan(t or "", templates, coverage, known)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [b.schema.names[0], "notices"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(id_col, notices) of every row; notices is array<struct<start, end, license, coverage>> by start.

    Null and empty texts have none; a very long one is searched whole, by its task. Of overlapping notices the best covered
    is named. Repeated rows get equal results; an empty table gives an empty one; other columns are not looked at, whatever
    their names.
    """
    rows = in_small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(_scan(templates, coverage), f"`{id_col}` {kind}, notices array<struct<start:bigint,end:bigint,license:string,coverage:double>>")


def license_query(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    best = F.array_max(F.transform("notices", lambda x: x["coverage"]))
    return found.select("doc_id", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license"]))), ",").alias("licenses"), best.alias("coverage"), F.array_join(spans, ",").alias("spans"))
