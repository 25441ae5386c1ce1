"""License notices in texts, by patience alignment with templates.

Where a template may lie, text and template are aligned: words that are unique to
both are matched, the longest increasing run of the matches anchors the alignment,
and the gaps between anchors are aligned in the same way. The share of the
template's words that are matched is its coverage.

A hit of coverage c lacks at most ``(1 - c) * words`` of the template, so at least
one of any more words than that is in it; alignments start from the places of the
rarest such words. Each has a window of the template's length, so that neighbouring
notices don't hide one another, and wider ones on either side: by up to a quarter of
the template, and on as long as doubling that brings in matched words. Texts without
enough of a template's words are passed over, by the same count.

Defined cases: null and empty texts have no hit; hits of a template don't overlap,
the better and then the earlier one stays; offsets count code points; repeated rows
and null ids give their own rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.workers import slices

WORD = re.compile(r"[^\W_]+")
#: Notices in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
COVERAGE = 0.85


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (sorted by their first) whose seconds rise."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, both rising."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        anchors = _rising([(i, place[a[i]]) for i in range(a0, a1) if here[a[i]] == 1 and there[a[i]] == 1])
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:]) if r > p + 1 and s > q + 1]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float = COVERAGE):
        self.name = name
        self.words = WORD.findall(text.lower())
        self.need = math.ceil(coverage * len(self.words) - 1e-9)
        self.spare = len(self.words) - self.need
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.screen = sorted(self.places, key=lambda w: (-len(w), w))

    def may_hold(self, lower: str) -> bool:
        missing = 0
        for w in self.screen:
            if w not in lower:
                missing += len(self.places[w])
                if missing > self.spare:
                    return False
        return True

    def _around(self, words: list[str], start: int, done: dict[tuple[int, int], list]) -> None:
        """Alignments by window: the template's length from ``start``, then more words on either side and on both.

        They double up to a quarter of the template, and on as long as that matches further words.
        """
        n, best, more = len(self.words), 0, 0
        while best < n:
            before = best
            for left, right in ((more, 0), (0, more), (more, more)) if more else ((0, 0),):
                window = max(0, start - left), min(len(words), start + n + right)
                if window not in done:
                    done[window] = patience(words[slice(*window)], self.words)
                best = max(best, len(done[window]))
            if more >= n // 4 + 2 and best == before or more > len(words):
                break
            more = 2 * more or 1

    def find(self, words: list[str], where: dict[str, list[int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, last word) of each hit."""
        rare = sorted(self.places, key=lambda w: (len(where.get(w, ())), w))
        chosen, held = [], 0
        for w in rare:
            chosen.append(w)
            held += len(self.places[w])
            if held > self.spare:
                break
        hits, done = [], {}
        for start in sorted({p - t for w in chosen for p in where.get(w, ()) for t in self.places[w]}):
            self._around(words, start, done)
        for (a, _), matched in done.items():
            if len(matched) >= self.need:
                hits.append((len(matched) / len(self.words), a + matched[0][0], a + matched[-1][0]))
        kept: list[tuple[float, int, int]] = []
        for hit in sorted(set(hits), key=lambda h: (-h[0], h[2] - h[1], h[1])):
            if all(hit[2] < k[1] or hit[1] > k[2] for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda h: h[1])


def find(text: str, templates: list[Template]) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of each hit in ``text``, offsets in code points of the lower-cased text."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter that grows: keep the offsets
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    may = [t for t in templates if t.may_hold(lower)]
    if not may:
        return []
    spans = [m.span() for m in WORD.finditer(lower)]
    words = [lower[a:b] for a, b in spans]
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    return [(t.name, c, spans[a][0], spans[b][1]) for t in may for c, a, b in t.find(words, where)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start and end of each hit, in one pass without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v, coverage) for k, v in templates.items()]
        for batch in slices(batches):
            out = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for hit in find(text, known)]
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "coverage", "start", "end"])

    return rows.mapInArrow(run, "doc_id long, license string, coverage double, start int, end int")
