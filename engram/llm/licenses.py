"""License scans by patience alignment of texts with license templates (operator 3).

Words that are unique to both a stretch of text and a template are anchors; the longest increasing
subsequence of them is kept, and the gaps between are aligned in the same way.  Coverage is the
share of the template's words that the alignment matches.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engram.llm import words as W
from engram.llm.common import map_arrow, pieces, table, utf8

#: The least coverage that counts as a find.
COVERAGE = 0.8
#: A stretch of text reaches beyond a template's ends by this share of the template's words, and 2.
SLACK = 0.25
BATCH_BYTES = 1 << 21

#: Public license notices and license texts, one or more templates a license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    ("All-Rights-Reserved", "All rights reserved."),
)


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence; values are distinct."""
    tails: list[int] = []
    places: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = places[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (i in a, j in b), increasing in both.

    Equal heads and tails are matched first, then anchors; a gap without anchors matches nothing.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
        pairs = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and x in at]
        anchors = [pairs[k] for k in longest_increasing([i for i, _ in pairs])]
        if anchors:
            found += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(i + 1, p, j + 1, q) for (i, j), (p, q) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


@dataclass
class Template:
    name: str
    words: list[int]

    @classmethod
    def of(cls, name: str, text: str) -> Template:
        return cls(name, W.words(text.encode(), W.ALNUM)[0].tolist())

    def slack(self) -> int:
        return int(len(self.words) * SLACK) + 2

    def cover(self, text: list[int], places: dict[int, list[int]], least: float) -> list[tuple[float, int, int]]:
        """The coverages of at least ``least``, and the words [start, end) of the text that give them.

        Every stretch of the text is aligned that has enough of the template's words, each counted
        as often as the template has it: no other can reach the coverage.
        """
        size, n = len(self.words), len(text)
        need = math.ceil(least * size - 1e-9)
        own = np.sort(np.concatenate([np.array(places[x], np.int64) for x in set(self.words) if x in places] or [np.empty(0, np.int64)]))
        reach = np.unique((own[:, None] + np.array([-size - self.slack(), self.slack() + 1])).ravel())
        if not len(reach):
            return []
        shifts = np.arange(max(-size, int(reach[0])), min(n, int(reach[-1])) + 1)
        windows = np.unique(np.stack([np.maximum(shifts - self.slack(), 0), np.clip(shifts + size + self.slack(), 0, n)], axis=1), axis=0)
        windows = windows[np.searchsorted(own, windows[:, 1]) - np.searchsorted(own, windows[:, 0]) >= need]
        most = np.zeros(len(windows), np.int64)
        for x, times in Counter(self.words).items() if len(windows) else ():
            at = np.array(places.get(x, ()), np.int64)
            most += np.minimum(np.searchsorted(at, windows[:, 1]) - np.searchsorted(at, windows[:, 0]), times)
        found = set()
        for begin, end in windows[most >= need].tolist():
            matches = patience(text[begin:end], self.words)
            if matches and len(matches) / size >= least:
                found.add((len(matches) / size, begin + matches[0][0], begin + matches[-1][0] + 1))
        return sorted(found)


class Scanner:
    """All templates; a text that lacks too many of a template's words is not aligned with it."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.templates = [t for t in (Template.of(*x) for x in templates) if t.words]
        self.coverage = coverage
        self.vocabulary = np.unique(np.array([x for t in self.templates for x in t.words], np.uint64))
        self.distinct = [Counter(t.words) for t in self.templates]

    def scan(self, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of the found licenses, those of most words first, each once."""
        if not len(hashes) or not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        own = np.flatnonzero(self.vocabulary[at] == hashes)
        places: dict[int, list[int]] = {}
        for i, x in zip(own.tolist(), hashes[own].tolist(), strict=True):
            places.setdefault(x, []).append(i)
        text: list[int] | None = None
        candidates: list[tuple[float, float, str, int, int]] = []
        for template, counts in zip(self.templates, self.distinct, strict=True):
            most = sum(min(n, len(places.get(x, ()))) for x, n in counts.items())
            if most < self.coverage * len(template.words):
                continue
            text = hashes.tolist() if text is None else text
            for coverage, start, end in template.cover(text, places, self.coverage):
                candidates.append((-coverage * len(template.words), -coverage, template.name, start, end))
        # what overlaps a find of more words is no find of its own
        found: dict[str, tuple[float, int, int]] = {}
        taken: list[tuple[int, int]] = []
        for _, coverage, name, start, end in sorted(candidates):
            k = bisect_left(taken, (start, end))
            if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end))
                found.setdefault(name, (-coverage, start, end))
        return [(name, *x) for name, x in found.items()]


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_licenses and licenses for every row.

    license is the one with the most matched words (ties: higher coverage, then by name); licenses
    has the names of all that reach ``coverage`` in places of their own, sorted and comma-joined.  A null or empty text, or one without a
    license, has null license and 0 in the other columns, and an empty list.  Repeated rows keep
    their own rows; an empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in pieces(batches, "text", BATCH_BYTES):
            rows: list[tuple] = []
            for first, last, h, bounds, _, _ in W.batches(utf8(batch.column(1)), W.ALNUM):
                for i in range(last - first):
                    found = scanner.scan(h[bounds[i] : bounds[i + 1]])
                    name, best, start, end = found[0] if found else (None, 0.0, 0, 0)
                    rows.append((name, best, start, end, len(found), ",".join(sorted(x[0] for x in found))))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "license", "coverage", "start_word", "end_word", "n_licenses", "licenses"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, license string, coverage double, start_word long, end_word long, n_licenses long, licenses string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
