"""License scan: winnowed fingerprints of notice templates find candidates, banded alignment measures them.

Templates are cut into lower-case words. Of the hashes of all runs of ``GRAM`` words, winnowing keeps the
smallest in every ``WINDOW`` neighbours; the inverted index holds where each kept one stands in which
template. A document looks up every run of its own words, so a shared stretch of ``GRAM + WINDOW - 1``
words always meets the index. Hits on nearby diagonals of one template make one candidate; aligning the
template with the words around it, within a band, gives matched words, coverage and the span of text.

A null or empty text has no matches. Every occurrence is reported, those of repeated rows once per row.
Empty tables give no rows. Where candidates of one template overlap, the one with most matched words stays.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from caravel.llm.frames import pick, slices

GRAM, WINDOW, LEAST_COVERAGE = 3, 3, 0.8
WORD = re.compile(r"\w+")

# Notices as their licences give them, and the one-line forms in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
    "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
    "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "MIT line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary line": "All rights reserved.",
}


def winnow(hashes: list[int], window: int = WINDOW) -> set[int]:
    """Places of the smallest hash (the last of equals) in every run of ``window``; of all if there are fewer."""
    runs = range(max(1, len(hashes) - window + 1))
    return {min(range(i, min(i + window, len(hashes))), key=lambda j: (hashes[j], -j)) for i in runs if hashes}


class Index:
    """Winnowed fingerprints of templates by word numbers; built once per Python worker from a few kilobytes of text."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [WORD.findall(templates[n].lower()) for n in self.names]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            grams = self.grams(ws)
            for place in winnow([xxhash.xxh64_intdigest(int(g).to_bytes(8, "little")) for g in grams]):
                self.postings[int(grams[place])].append((t, place))
        self.kept = np.array(sorted(self.postings), np.int64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Runs of words as one number each; runs with a word that no template has are -1."""
        base = len(self.number) + 1
        if len(numbers) < GRAM:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(numbers) - GRAM + 1, np.int64), np.ones(len(numbers) - GRAM + 1, bool)
        for i in range(GRAM):
            part = numbers[i : len(numbers) - GRAM + 1 + i]
            out, known = out * base + part, known & (part > 0)
        return np.where(known, out, -1)

    def candidates(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """Template, first and last diagonal of every bundle of hits."""
        grams = self.grams(numbers)
        hits = np.flatnonzero(np.isin(grams, self.kept))
        diagonals = sorted((t, int(at) - place) for at in hits for t, place in self.postings[int(grams[at])])
        bundles: list[tuple[int, int, int]] = []
        for t, diagonal in diagonals:
            if bundles and bundles[-1][0] == t and diagonal - bundles[-1][2] <= band(len(self.words[t])):
                bundles[-1] = (t, bundles[-1][1], diagonal)
            else:
                bundles.append((t, diagonal, diagonal))
        return bundles


def band(length: int) -> int:
    return max(2, length // 10)


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most words in common along diagonals low..high: matched, first and last (exclusive) word of the span.

    Skipped words on either side cost nothing but width of the band; ties prefer the shorter span.
    """
    width = high - low + 1
    none = (0, 0, 0)  # matched, minus span, first word
    before = [none] * width
    ends = none
    last = 0
    for i in range(len(template)):
        now = []
        for d in range(width):
            j = i + low + d
            best = before[d + 1] if d + 1 < width else none  # a template word skipped
            if d and now[d - 1][0] > best[0]:
                best = now[d - 1]  # a document word skipped
            elif d and now[d - 1][0] == best[0] and now[d - 1][2] > best[2]:
                best = now[d - 1]
            if 0 <= j < len(words) and words[j] == template[i]:
                matched, _, first = before[d]
                one = (matched + 1, 0, first if matched else j)
                if one[0] > best[0] or (one[0] == best[0] and one[2] > best[2]):
                    best = one
                    if (best[0], best[2] - j) > (ends[0], ends[2] - last):
                        ends, last = best, j
            now.append(best)
        before = now
    return ends[0], ends[2], last + 1


def matches(index: Index, text: str, least: float = LEAST_COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """Template, matched words, coverage, and span in characters, in order of place."""
    found, starts, ends, known, number = [], array("q"), array("q"), array("q"), index.number
    for word in WORD.finditer(text):
        starts.append(word.start())
        ends.append(word.end())
        known.append(number.get(word.group().lower(), 0))
    numbers = np.array(known, np.int64)
    for t, low, high in index.candidates(numbers):
        template = index.words[t]
        edge = band(len(template))
        matched, first, end = align(template, numbers, low - edge, high + edge)
        if matched / len(template) >= least:
            found.append((t, matched, starts[first], ends[end - 1]))
    kept: list[tuple[int, int, int, int]] = []
    for one in sorted(found, key=lambda f: (-f[1], f[2], f[0])):
        if not any(one[0] == k[0] and one[2] < k[3] and k[2] < one[3] for k in kept):
            kept.append(one)
    return [(index.names[t], n, n / len(index.words[t]), a, b) for t, n, a, b in sorted(kept, key=lambda k: (k[2], k[0]))]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """Columns key, template, matched_words, coverage, span_start and span_end (characters), a row per match."""
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for part in slices(batches, 1):
            at, found = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                mine = matches(index, text or "", least)
                at += [i] * len(mine)
                found += mine
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["key", "template", "matched_words", "coverage", "span_start", "span_end"],
            )

    schema = f"key {kind}, template string, matched_words bigint, coverage double, span_start bigint, span_end bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
