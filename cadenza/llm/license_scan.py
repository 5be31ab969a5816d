"""Licence scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

Bounds on size prune templates: Dice at least t needs sizes a, b with a t <= b (2 - t) and the other way round, so a
unit of text is compared only with templates in that range that share a bigram with it. Spans of any place and length
are compared too: those that begin and end with a bigram of the template, as no other span is the closest.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import short_batches, texts_of, with_columns

WORD = re.compile("[A-Za-z0-9]+")

#: Wordings of public licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause-terms": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software."),
    "proprietary": "All rights reserved.",
}


#: Whole licence texts and longer notices, which spans are compared with besides the templates.
TEXTS = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))} | {
    f"{short}-header": TEMPLATES["GPL-header"].replace("GNU General", f"GNU {kind} General") for short, kind in (("AGPL", "Affero"), ("LGPL", "Lesser"))}


def bigrams(text: str) -> set[str]:
    """Distinct pairs of neighbouring words (ASCII letters and digits, lower-cased)."""
    words = [w.lower() for w in WORD.findall(text)]
    return set(map(" ".join, zip(words, words[1:], strict=False)))


def units(text: str) -> Iterator[tuple[int, str]]:
    """What is compared, with its place: each line, each paragraph of several lines, and a text of several paragraphs as a whole."""
    paragraphs = text.split("\n\n")
    at = 0
    for p in paragraphs:
        lines, start = p.split("\n"), at
        for line in lines:
            yield at, line
            at += len(line) + 1
        if len(lines) > 1:
            yield start, p
        at += 1
    if len(paragraphs) > 1:
        yield 0, text


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, texts: dict[str, str] | None = None) -> None:
        self.sets = {name: bigrams(t) for name, t in sorted(templates.items())}
        self.threshold = threshold
        self.having: dict[str, list[str]] = {}
        for name, s in self.sets.items():
            for b in s:
                self.having.setdefault(b, []).append(name)
        sizes = [len(s) for s in self.sets.values()] or [0]
        self.least, self.most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
        self.whole = self.sets | {name: bigrams(t) for name, t in (texts or {}).items()}
        self.holders: dict[str, list[str]] = {}
        for name, s in self.whole.items():
            for b in s:
                self.holders.setdefault(b, []).append(name)
        self.held = frozenset(self.holders)

    def match(self, unit: str) -> tuple[float, str] | None:
        """The closest template and its Dice coefficient, if it reaches the threshold; ties to the first by name."""
        if 2 * len(unit) < self.least:
            return None
        mine = bigrams(unit)
        a = len(mine)
        if not self.least <= a <= self.most:
            return None
        shared = Counter(name for b in mine if b in self.having for name in self.having[b])
        best = None
        for name, n in shared.items():
            b = len(self.sets[name])
            if a * self.threshold > b * (2 - self.threshold) or b * self.threshold > a * (2 - self.threshold):
                continue
            dice = 2 * n / (a + b)
            if dice >= self.threshold and (best is None or (-dice, name) < (-best[0], best[1])):
                best = dice, name
        return best

    def ends(self, pairs: list[str], before: np.ndarray, after: np.ndarray, low: int, high: int, name: str) -> Iterator[tuple[int, float, str, int, int]]:
        """Per bigram of the template in low to high the closest span from there: bigrams shared, Dice, name, first and last word + 1.

        Only places where a bigram comes up for the first time since the start change a span's Dice. They are kept in
        order from start to start: a start leaves, the next place of its bigram comes in. So a start costs what the
        template holds, however often the text repeats itself. Where all bigrams up to the next start come again
        before any span can match, both starts have the same closest end.
        """
        mine, t = self.whole[name], self.threshold
        b = len(mine)
        most = int(b * (2 - t) / t) + 1
        mark = np.fromiter((p in mine for p in pairs[low:high]), bool, high - low)
        # distinct bigrams of the template from each place on
        left = np.cumsum((mark & (after[low:high] >= high))[::-1])[::-1]
        useful = np.flatnonzero(mark & (left * (2 - t) >= b * t - 1e-9))
        if not len(useful):
            return
        i = low + int(useful[0])
        new = i + np.flatnonzero(before[i:high] < i)
        near, rest, at, later = array("q", new[: 2 * most].tolist()), new[2 * most :].tolist(), 0, []
        nexts, marked = after[low : low + int(useful[-1]) + 1].tolist(), mark.tolist()
        following = np.append(useful[1:], len(nexts)).tolist()[::-1]
        fewest, rising, same = math.ceil(b * t / (2 - t) - 1e-9), np.arange(1, most + 1) + b, []
        for i in range(i, low + len(nexts)):
            again = nexts[i - low]
            if marked[i - low]:
                same.append(i)
                then = following.pop()
                if then == len(nexts) or len(near) < fewest or max(nexts[i - low : then]) >= near[fewest - 1]:
                    places = np.frombuffer(near, np.int64, min(len(near), most))
                    hit = np.cumsum(mark[places - low])
                    dice = 2 * hit / rising[: len(hit)]
                    j = int(dice.argmax())
                    if dice[j] >= t:
                        yield from ((int(hit[j]), float(dice[j]), name, k, int(places[j]) + 2) for k in same)
                    del places
                    same.clear()
            near.pop(0)
            if again < high:
                if near and again < near[-1]:
                    insort(near, again)
                else:
                    heappush(later, again)
            if len(near) < most:
                while len(near) < 2 * most and (at < len(rest) or later):
                    if at < len(rest) and not (later and later[0] < rest[at]):
                        near.append(rest[at])
                        at += 1
                    else:
                        near.append(heappop(later))

    def spans(self, words: list[str]) -> list[tuple[int, float, str, int, int]]:
        """Spans that match and don't overlap: of a template the closest, of several those that share most, then the closest."""
        pairs = list(map(" ".join, zip(words, words[1:], strict=False)))
        taken: list[tuple[int, float, str, int, int]] = []
        todo, before, after = [(0, len(pairs))], None, None
        while todo:
            low, high = todo.pop()
            known = self.held.intersection(pairs[low:high])
            shared = Counter(name for b in known for name in self.holders[b])
            names = [name for name, n in shared.items() if n * (2 - self.threshold) >= len(self.whole[name]) * self.threshold - 1e-9]
            if not names:
                continue
            if before is None:
                last: dict[str, int] = {}
                before = np.empty(len(pairs), np.int64)
                for i, p in enumerate(pairs):
                    before[i] = last.get(p, -1)
                    last[p] = i
                after = np.full(len(pairs), len(pairs), np.int64)
                again = np.flatnonzero(before >= 0)
                after[before[again]] = again

            def apart(found: Iterable[tuple[int, float, str, int, int]]) -> tuple[list[tuple[int, float, str, int, int]], np.ndarray]:
                free, out = np.ones(high - low + 1, bool), []
                for f in found:
                    if free[f[3] - low : f[4] - low].all():
                        free[f[3] - low : f[4] - low] = False
                        out.append(f)
                return out, free

            each = [apart(sorted(self.ends(pairs, before, after, low, high, name), key=lambda f: (-f[1], -f[0], f[3])))[0] for name in names]
            found, free = apart(sorted((f for e in each for f in e), key=lambda f: (-f[0], -f[1], *f[2:])))
            taken += found
            if found:  # what is left between them is looked at again
                edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))) + low
                todo += [(a, z - 1) for a, z in edges.reshape(-1, 2).tolist() if z - a > 1]
        return taken

    def find(self, text: str) -> tuple[tuple[float, str] | None, int]:
        """The closest template of a text, with its Dice coefficient, and the number of matches."""
        hits = [(m, at, u) for at, u in units(text) if (m := self.match(u))]
        tokens = [(w.start(), w.group().lower()) for w in WORD.finditer(text)]
        spans = self.spans([w for _, w in tokens])
        if not spans:
            return min((m for m, _, _ in hits), key=lambda m: (-m[0], m[1]), default=None), len(hits)
        at = [a for a, _ in tokens]
        places = [(m, bisect_left(at, a), bisect_left(at, a + len(u))) for m, a, u in hits]
        # a unit inside a longer span is part of that span's text
        named = [m for m, a, z in places if not any(s[3] <= a and z <= s[4] and z - a < s[4] - s[3] for s in spans)] + [(s[1], s[2]) for s in spans]
        more = sum(not any(a < s[4] and s[3] < z for _, a, z in places) for s in spans)
        return min(named, key=lambda m: (-m[0], m[1])), len(hits) + more


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, license (closest template of any unit or span, null if none), dice, n_matches (units that
    match, and spans that match outside of these).

    Whole texts are scanned by ``units`` and spans where they are read, without a shuffle. Null and empty texts, and units of
    fewer than two words, match nothing; ties go to the first name; repeated rows give a row each, other columns are
    left out.
    """
    short_batches(docs.sparkSession)
    named, texts = (TEMPLATES, TEXTS) if templates is None else (templates, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(named, threshold, texts)
        for batch in batches:
            found = [s.find(t) for t in texts_of(batch, "t")]
            yield with_columns(batch, ["k"], {
                "license": pa.array([b and b[1] for b, _ in found], pa.string()), "dice": pa.array([b and b[0] for b, _ in found], pa.float64()),
                "n_matches": pa.array([n for _, n in found], pa.int64())})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, license string, dice double, n_matches long")
    return out.withColumnRenamed("k", key)
