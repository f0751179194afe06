"""Licence scans by patience alignment.

A template and a stretch of a text are aligned like this: the words that occur once in each are anchors;
the longest increasing run of their positions is kept; before, between and after the kept anchors the same is
done again, with words that have become unique there; equal words at a gap's ends are matched first. The
coverage is the share of the template's words that are matched.

Stretches are found without a miss: a match that covers a share t of a template of n words lacks at most
n - ceil(t * n) of them, so it has one of any n - ceil(t * n) + 1 words of the template. The words that are
rarest in the templates' language serve as these seeds, and only the surroundings of seeds, twice a template
wide on both sides, are aligned. Where several copies stand close together no word occurs once, so a stretch that
holds enough words but gives no match, or a loose one, is gone through again in windows about a template wide,
from where a copy with the seed would begin."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The licences' wording, without the holder's name and year.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
}
COVERAGE = 0.8
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of ASCII letters and digits, a version number being one."""
    return WORD.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run, by patience piles with back pointers."""
    tops: list[int] = []
    top_at: list[int] = []
    back = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1], top_at[pile : pile + 1] = [v], [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of words in a and b, increasing in both, by patience alignment."""
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
        n, m = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if n[w] == 1 and m.get(w) == 1}
        anchors = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        kept = [anchors[i] for i in increasing([i for i, _ in anchors])]
        last_a, last_b = a0, b0
        for i, j in kept:
            out.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if kept:
            todo.append((last_a, a1, last_b, b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {k: words_of(v) for k, v in (templates or TEMPLATES).items()}
        held = Counter(w for words in self.templates.values() for w in words)
        #: Words by how well they tell: those of few letters and of many templates last.
        self.seeds: dict[str, set[str]] = {}
        self.places: dict[str, dict[str, list[int]]] = {}
        for name, words in self.templates.items():
            if not words:
                raise ValueError(f"{name} has no words")
            lacking = len(words) - math.ceil(coverage * len(words) - 1e-9)
            left = Counter(words)
            seeds: set[str] = set()
            taken = 0
            for w in sorted(left, key=lambda w: (-min(len(w), 7), held[w], w)):
                if taken > lacking:
                    break
                seeds.add(w)
                taken += left[w]
            self.seeds[name] = seeds
            #: Where each seed stands in its template.
            self.places[name] = {w: [p for p, x in enumerate(words) if x == w] for w in seeds}
        self.all = frozenset().union(*self.seeds.values())

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, template's words, first and last matched word) by place."""
        words = words_of(text)
        if self.all.isdisjoint(words):
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.all:
                at.setdefault(w, []).append(i)
        found = []
        for name, template in self.templates.items():
            n = len(template)
            places = sorted(i for w in self.seeds[name] for i in at.get(w, ()))
            stretches: list[list[int]] = []
            for i in places:
                low, high = max(0, i - 2 * n), min(len(words), i + 2 * n + 1)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                # long stretches are gone through in steps of a template, four templates at a time
                starts = range(low, high, n) if high - low > 4 * n + 1 else (low,)
                todo = [(start, min(high, start + 4 * n + 1)) for start in starts]
                while todo:
                    start, end = todo.pop()
                    match, singles, span = self._match(words[start:end], template), [], (start, end)
                    if match:
                        first, last = start + match[0][1], start + match[-1][1]
                        todo += ((start, first), (last + 1, end))
                        span = (max(0, first - 2 * n), min(len(words), last + 2 * n + 1))
                    if end - start > n and (last - first >= n + n // 4 if match else self._holds(words[start:end], template)):
                        singles = self._single(words, *span, name)
                    # a loose match that takes its words from several copies is none
                    if match and sum(m[0][1] <= last and first <= m[-1][1] for m in singles) < 2:
                        singles.append([(a, start + b) for a, b in match])
                    found += [(name, len(m) / n, len(m), n, m[0][1], m[-1][1]) for m in singles]
        return self._apart(found)

    def _holds(self, part: list[str], template: list[str]) -> bool:
        """Whether a part has enough of the template's words in any order."""
        least = self.coverage * len(template) - 1e-9
        return len(part) >= least and (Counter(template) & Counter(part)).total() >= least

    def _single(self, words: list[str], start: int, end: int, name: str) -> list[list[tuple[int, int]]]:
        """Matches in words[start:end], each by itself, from left to right: of the windows that fit a seed the one
        with the most words for the match's width."""
        template, places = self.templates[name], self.places[name]
        n, out, free = len(template), [], start
        spare = max(1, n // 4)
        for i in range(start, end):
            if i < free or words[i] not in places:
                continue
            best: list[tuple[int, int]] = []
            for p in places[words[i]]:
                for low, high in ((i - p, i - p + n), (i - p - spare, i - p + n + spare), (i - p, i - p + 2 * n)):
                    low = max(low, free)
                    pairs = [(a, low + b) for a, b in self._match(words[low : min(high, end)], template)]
                    best = max(best, pairs, key=lambda m: 2 * len(m) + m[0][1] - m[-1][1] if m else -1)
            if best:
                out.append(best)
                free = best[-1][1] + 1
        return out

    def _match(self, part: list[str], template: list[str]) -> list[tuple[int, int]]:
        """The aligned words, if they cover enough of the template."""
        least = self.coverage * len(template) - 1e-9
        if not self._holds(part, template):
            return []
        pairs = self._compact(aligned(template, part), len(template))
        return pairs if len(pairs) >= least else []

    def _compact(self, pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The most matches within twice the template's width of text."""
        best, low = (0, 0), 0
        for high, (_, j) in enumerate(pairs):
            while j - pairs[low][1] >= 2 * n:
                low += 1
            best = max(best, (high + 1 - low, -low))
        return pairs[-best[1] : -best[1] + best[0]]

    def _apart(self, found: list) -> list:
        """Of matches that overlap, the one with most words, then most coverage, then the narrowest, stays."""
        out: list = []
        for x in sorted(set(found), key=lambda x: (-x[2], -x[1], x[5] - x[4], x[4], x[0])):
            if all(x[5] < y[4] or y[5] < x[4] for y in out):
                out.append(x)
        return sorted(out, key=lambda x: x[4])


_MATCH = "struct<license: string, coverage: double, matched: int, size: int, first: int, last: int>"


def matches(text: Column, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> Column:
    """The licences in a text, an array of structs by place; positions are numbers of words."""
    scanner = Scanner(templates, coverage)

    @F.arrow_udf(f"array<{_MATCH}>")
    def of(texts):
        import pyarrow as pa

        names = ("license", "coverage", "matched", "size", "first", "last")
        kind = pa.struct([*zip(names, (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)])
        return pa.array([[dict(zip(names, m, strict=True)) for m in scanner.scan(t.as_py())] for t in texts], pa.list_(kind))

    return of(text)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, matches) for each row of docs.

    A null text has no matches. Null and repeated doc_ids are rows like others; an empty table gives no
    rows; other columns are not read."""
    return docs.select("doc_id", matches(F.col("text"), templates, coverage).alias("matches"))
