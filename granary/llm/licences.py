"""Licence scans by the Dice coefficient over word bigrams (operator 10).

Texts and templates are normalised alike: lower case, words of letters and digits, everything else a blank. A segment, a
line or some lines in succession, matches a template when 2 * |A and B| / (|A| + |B|) over their sets of word bigrams is
at least THRESHOLD. For that, |A| must lie between |B| * t / (2 - t) and |B| * (2 - t) / t: templates outside these
bounds are pruned by their size alone, and an index from bigrams to templates gives the intersections of the others, so
a segment that shares no bigram with a template costs only its normalisation. Where no such segment matches, windows of
words do, wherever they start and end: inside a line, over line ends, in a text of one line. A window starts and ends at
bigrams of its template, and is tried only where enough of them stand close together. Scanning is row by row, without shuffles;
a segment of several lines has at most twice as many words as the largest template's bound, so memory follows the longest
text.

Defined results: null and empty texts match nothing; of equal coefficients the template named first in the alphabet
counts; overlapping segments that match the same licence give the one of highest coefficient, then the earliest;
of windows that overlap, whatever their licences, that one alone; a segment of one word has no bigram and matches nothing; repeated rows each give their row; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame

from granary.llm.batches import map_texts

THRESHOLD = 0.75

#: Names under which licences are cited; the statements below are made from them by rule.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0"],
    "MIT": ["the MIT License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
STATEMENTS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is distributed under the terms of {}."]
#: Notices that stand at the head of files.
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}

_word = re.compile(r"[^\W_]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _word.findall(text.lower())
    return set(zip(words, words[1:], strict=False))


class Disjoint:
    """Intervals that don't overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether [start, end) overlaps none so far; then it is one of them."""
        k = bisect_right(self.starts, start)
        if k and self.ends[k - 1] > start or k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


class Templates:
    def __init__(self, threshold: float = THRESHOLD, texts: list[tuple[str, str]] | None = None):
        """texts: pairs of a licence's name and a template; without them, those of this module."""
        if texts is None:
            texts = [(k, s.format(n)) for k, ns in NAMES.items() for n in ns for s in STATEMENTS] + list(NOTICES.items())
        self.threshold = threshold
        self.names, sets = zip(*((k, b) for k, t in sorted(texts) if (b := bigrams(t))), strict=True)
        self.sizes = [len(b) for b in sets]
        self.index: dict[tuple[str, str], list[int]] = {}
        for i, b in enumerate(sets):
            for g in b:
                self.index.setdefault(g, []).append(i)
        self.most = max(self.sizes) * (2 - threshold) / threshold

    def best(self, grams: set) -> tuple[float, str] | None:
        """The highest coefficient of a segment with a template, and its licence."""
        n, t = len(grams), self.threshold
        shared = Counter(i for g in grams & self.index.keys() for i in self.index[g] if self.sizes[i] * t <= n * (2 - t) and n * t <= self.sizes[i] * (2 - t))
        found = [(-2 * c / (n + self.sizes[i]), self.names[i]) for i, c in shared.items()]
        if found and -min(found)[0] >= t:
            dice, name = min(found)
            return -dice, name
        return None

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """licence, coefficient, first line and number of lines of each match."""
        index = self.index.keys()
        lines = text.split("\n")
        flagged = []
        for at, line in enumerate(lines):
            grams = bigrams(line)
            if not index.isdisjoint(grams):
                flagged.append((at, len(grams)))
        found = []
        for k, (first, _) in enumerate(flagged):
            words: list[str] = []
            upto = first
            for last, size in flagged[k:]:
                if size > self.most and last > first:
                    break
                for ln in lines[upto : last + 1]:
                    words += _word.findall(ln.lower())
                upto = last + 1
                grams = set(zip(words, words[1:], strict=False))
                if len(grams) > self.most or len(words) > 2 * self.most:
                    break
                if (best := self.best(grams)) is not None:
                    found.append((best[1], best[0], first, last - first + 1))
        found.sort(key=lambda m: (-m[1], m[2], m[3], m[0]))
        taken = {name: Disjoint() for name in {m[0] for m in found}}
        kept = [m for m in found if taken[m[0]].add(m[2], m[2] + m[3])]
        return sorted(kept + self.windows(lines, kept), key=lambda m: (m[2], m[0]))

    def windows(self, lines: list[str], taken: list) -> list[tuple[str, float, int, int]]:
        """As `scan`, the matches of windows of words outside the lines of the matches `taken`."""
        covered = {i for m in taken for i in range(m[2], m[2] + m[3])}
        out: list = []
        words: list[str] = []
        where: list[int] = []
        for i, line in enumerate([*lines, ""]):
            if i == len(lines) or i in covered:
                out += [(m[1], -m[0], where[m[2]], where[m[3]] - where[m[2]] + 1) for m in self._windows(words)]
                words, where = [], []
            else:
                new = _word.findall(line.lower())
                words += new
                where += [i] * len(new)
        return out

    def _windows(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """Minus coefficient, licence, first and last word of the windows that match, none overlapping another."""
        pairs = list(zip(words, words[1:], strict=False))
        hits = self.index.keys() & set(pairs)
        t = self.threshold
        shared = Counter(i for g in hits for i in self.index[g])
        places: dict[int, list[int]] = {i: [] for i, c in shared.items() if c * (2 - t) >= self.sizes[i] * t}
        if not places:
            return []
        for at, g in enumerate(pairs):
            if g in hits:
                for i in self.index[g]:
                    if i in places:
                        places[i].append(at)
        found = []
        for i, at in places.items():
            size = self.sizes[i]
            least, most = size * t / (2 - t), size * (2 - t) / t
            for k, first in enumerate(at):
                # so many hits must stand within the longest window (a window may repeat bigrams, up to twice its bound)
                need = k + max(0, int(-(-least // 1)) - 1)
                if need >= len(at) or at[need] - first >= 2 * most:
                    continue
                seen, common, upto = set(), set(), first
                for last in at[k:]:
                    if last - first >= 2 * most:
                        break
                    seen.update(pairs[upto : last + 1])
                    upto = last + 1
                    if len(seen) > most:
                        break
                    common.add(pairs[last])
                    dice = 2 * len(common) / (len(seen) + size)
                    if dice >= t:
                        found.append((-dice, self.names[i], first, last + 1))
        found.sort(key=lambda m: (m[0], m[2] - m[3], m[2], m[1]))
        taken = Disjoint()
        return [m for m in found if taken.add(m[2], m[3] + 1)]


@lru_cache(maxsize=4)
def templates(threshold: float) -> Templates:
    return Templates(threshold)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every whole text: doc_id, n_matches, licences (distinct, in order of the alphabet), best_licence, best_dice, best_line (from 0)."""

    def start():
        known = templates(threshold)

        def work(ids: list, texts: list[str]) -> list:
            found = [known.scan(t) for t in texts]
            best = [min(f, key=lambda m: (-m[1], m[2], m[0])) if f else (None, None, None, None) for f in found]
            return [ids, [len(f) for f in found], [sorted({m[0] for m in f}) for f in found], [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]]

        return work

    return map_texts(df, "doc_id long, n_matches long, licences array<string>, best_licence string, best_dice double, best_line long", start, id_col, text_col)
