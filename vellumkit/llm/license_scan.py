"""License scans by patience alignment.

A template is aligned with a stretch of a text: words that are unique in both are anchors, the longest increasing
subsequence of the anchors' places is kept, and the gaps between them are aligned alike, after what they share at
either end is taken off. Coverage is the share of the template's words that are aligned; a license is found where
coverage is ``MIN_COVERAGE`` at least and the aligned words are half of the stretch at least. Coverage alone doesn't tell
licenses of a family apart, so a template has ``MARKS``: words that must be aligned, and words that the stretch may not hold.

A stretch is tried around each word of a text that is one of the template's triggers: its rarer words, so many that an
alignment with the coverage asked for can't do without all of them. So texts without any trigger, nearly all, cost
one set operation, and no other text is skipped. Of the windows around a trigger three for each of its places in the template are
aligned; if none of them will do, though the widest has enough words in common in their order, all are. Templates are constants; texts stay where they are, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import prepare

WORD = re.compile(r"\w+")
MIN_COVERAGE = 0.8
COMMON = frozenset("a an and any are as at be by for from in is it no not of on or other that the this to under use with you".split())

TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-line": "Released under the BSD License.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl-3-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def _marks() -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    other = {"3": "1 2", "2": "1 3", "4": "1 2 3"}  # versions that a stretch of this version may not hold
    out = {"mit-line": ("mit", ""), "bsd-line": ("bsd", ""), "apache-2.0-line": ("apache 2", "1"), "apache-2.0-header": ("apache 2", "1")}
    for v in "23":
        for form in ("line", "header"):
            out[f"gpl-{v}-{form}"] = (f"general public {v}", f"lesser library affero {other[v]}")
    out |= {"lgpl-3-line": ("lesser general public 3", f"affero {other['3']}"), "agpl-3-line": ("affero general public 3", f"lesser {other['3']}")}
    names = {"nc": ("noncommercial", "noncommercial non commercial"), "sa": ("sharealike", "sharealike share alike"), "nd": ("noderivatives", "noderivatives noderivs derivatives derivs")}
    for kind in ("", "nc", "sa", "nd", "nc-sa", "nc-nd"):
        own, name = kind.split("-") if kind else [], "-".join(filter(None, ["cc-by", kind, "4.0"]))
        out[f"{name}-line"] = (f"cc by 4 {' '.join(own)}", " ".join([other["4"], *(k for k in names if k not in own)]))
        out[name] = (f"attribution 4 {' '.join(names[k][0] for k in own)}", " ".join([other["4"], *(names[k][1] for k in names if k not in own)]))
    return {n: (frozenset(a.split()), frozenset(b.split())) for n, (a, b) in out.items()}


#: Of templates by name: words that must be among the aligned ones, and words that may not be in the stretch.
MARKS = _marks()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first part, whose second part increases (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = top_at[k - 1] if k else -1
        if k == len(tops):
            tops.append(b), top_at.append(i)
        else:
            tops[k], top_at[k] = b, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
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
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass
class Template:
    name: str
    words: list[str]
    triggers: dict[str, list[int]]  # a trigger's places in the template
    need: int
    count: Counter
    must: frozenset[str] = frozenset()
    bars: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.bits: dict[str, int] = {}  # a word's places in the template
        for i, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << i

    @classmethod
    def of(cls, name: str, text: str, min_coverage: float = MIN_COVERAGE) -> Template:
        words = WORD.findall(text.lower())
        need, count, triggers, left = ceil(min_coverage * len(words) - 1e-9), Counter(words), {}, 0
        for w in sorted(count, key=lambda w: (w in COMMON, count[w], -len(w), w)):
            if left > len(words) - need:
                break
            triggers[w] = [i for i, x in enumerate(words) if x == w]
            left += count[w]
        return cls(name, words, triggers, need, count, *(MARKS.get(name, ()) if TEMPLATES.get(name) == text else ()))

    def marked(self, own: list[tuple[int, int]], words: list[str]) -> bool:
        return self.must <= {self.words[i] for i, _ in own} and self.bars.isdisjoint(words[own[0][1] : own[-1][1] + 1])

    def in_order(self, words: list[str]) -> int:
        """Length of the longest common subsequence, by bits: no alignment has more words."""
        every = (1 << len(self.words)) - 1
        left = every
        for w in words:
            hit = left & self.bits.get(w, 0)
            left = ((left + hit) | (left - hit)) & every
        return len(self.words) - left.bit_count()

    def best(self, words: list[str]) -> tuple[int, list[tuple[int, int]]]:
        """(occurrences, the aligned places (in the template, in the text) of the best one)."""
        n, found, best, after = len(self.words), 0, [], 0
        tried: set[tuple[int, int]] = set()
        for p, w in enumerate(words):
            if p < after or w not in self.triggers:
                continue
            own: list[tuple[int, int]] = []

            def align_in(lo: int, hi: int) -> None:
                nonlocal own
                if (self.count & Counter(words[lo:hi])).total() < max(self.need, len(own) + 1):
                    return  # words in common are too few for any alignment
                got = [(i, j + lo) for i, j in align(self.words, words[lo:hi])]
                if len(got) > len(own) and 2 * len(got) >= got[-1][1] + 1 - got[0][1] and self.marked(got, words):
                    own = got

            for k in self.triggers[w]:
                for s in (0, n // 2 + 2, n):  # an insertion may be as long as the template
                    align_in(max(after, p - k - s), min(len(words), p - k + n + s))
                if len(own) == n:
                    break
            if len(own) < self.need:
                for k in self.triggers[w]:
                    lo, hi = max(after, p - k - n), min(len(words), p - k + 2 * n)
                    if (self.count & Counter(words[lo:hi])).total() < self.need or self.in_order(words[lo:hi]) < self.need:
                        continue
                    for a in range(lo, p + 1):
                        for b in range(max(p + 1, a + self.need), hi + 1):
                            if (a, b) not in tried:
                                tried.add((a, b))
                                align_in(a, b)
            if len(own) >= self.need:
                found, after = found + 1, own[-1][1] + 1
                tried.clear()
                if len(own) > len(best):
                    best = own
        return found, best


def scan(text: str, templates: list[Template]) -> list[tuple[str, int, int, int, float, int]]:
    """(license, start, end, words aligned, coverage, occurrences) of each template found; offsets of its best occurrence."""
    lower = text.lower()
    words = WORD.findall(lower)
    there = set(words)
    out, spans = [], None
    for t in templates:
        if not t.must <= there or there.isdisjoint(t.triggers) or sum(w in there for w in t.words) < t.need:
            continue
        found, best = t.best(words)
        if found:
            if spans is None:
                back = None if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
                spans = [(a, b) if back is None else (back[a], back[b - 1] + 1) for a, b in (m.span() for m in WORD.finditer(lower))]
            out.append((t.name, spans[best[0][1]][0], spans[best[-1][1]][1], len(best), round(len(best) / len(t.words), 6), found))
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each template found in a document: doc_id, license, start, end (offsets of the best occurrence, in Unicode
    characters), n_words (aligned), coverage, occurrences (that don't overlap).

    Texts without a license, null and empty ones give no row; repeated rows give theirs again, and a null doc_id stays
    null. A text that holds a license of which another is a part gets both. Whole texts are scanned. Other columns are not read.
    """
    prepare(docs.sparkSession)
    given = list((TEMPLATES if templates is None else templates).items())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Template.of(n, t, min_coverage) for n, t in given]
        ready = [t for t in ready if t.words]
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1)) if t.is_valid for x in scan(t.as_py(), ready)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "start", "end", "n_words", "coverage", "occurrences"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scanned, "doc_id bigint, license string, start bigint, end bigint, n_words int, coverage double, occurrences int")
