"""License notices in documents: fingerprints pick candidates, alignment measures them.

Templates and documents are cut into words of letters and digits in lower case. Of every two neighbouring
three-word runs the one with the smaller hash is a fingerprint (winnowing), so four equal words in a row
are always noticed. The templates' fingerprints form an inverted index. Where a document has some of them at about
the same offset to a template, a banded local alignment of the words finds the best match:
its coverage is the share of the template's words it has in order.

Null and empty texts have no matches. Rows repeated exactly match alike. Spans are code points,
ends exclusive.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gustledger.llm import words as W

GRAM = 3
#: Words that a match may shift against its template, and the least coverage reported.
BAND, LEAST = 8, 0.8

#: Notices as the licenses' authors word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def fingerprints(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of three-word runs, and the index of their first word."""
    hashes, at = W.grams(found, GRAM)
    if not len(at):
        return hashes, at
    near = (at[1:] == at[:-1] + 1) & (found.text[at[1:]] == found.text[at[:-1]])
    keep = np.zeros(len(at), bool)
    keep[:-1] |= near & (hashes[:-1] <= hashes[1:])
    keep[1:] |= near & (hashes[1:] <= hashes[:-1])
    alone = np.ones(len(at), bool)
    alone[:-1] &= ~near
    alone[1:] &= ~near
    keep |= alone
    return hashes[keep], at[keep]


class Index:
    """Inverted index: fingerprint to the templates that have it, and where."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        (block,) = W.blocks(pa.array(list(templates.values()), pa.large_string()), 1 << 30)
        found = W.words(block, W.NOT_ALNUM, W.LOWER)
        self.words = [found.hashes[found.first[i] : found.first[i + 1]] for i in range(len(block))]
        hashes, at = fingerprints(found)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.template = found.text[at[order]]
        self.place = (at - found.first[found.text[at]])[order]

    def candidates(self, hashes: np.ndarray, place: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per template: (offset of the template in the text, place) of every shared fingerprint of one text."""
        out = defaultdict(list)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        for i in np.flatnonzero(high > low).tolist():
            for j in range(int(low[i]), int(high[i])):
                out[int(self.template[j])].append((int(place[i] - self.place[j]), int(place[i])))
        return out


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with template word ``i`` at text words ``i + low .. i + high``.

    A match is worth 2, a skipped or replaced word costs 1. Returns matched words and the text range.
    """
    width = high - low + 1
    none = (0, 0, 0, 0)  # score, matches, first, end
    above = [none] * (width + 1)
    best = none
    for i, word in enumerate(template.tolist()):
        row = [none] * (width + 1)
        for k in range(width):
            j = i + low + k
            if not 0 <= j < len(text):
                continue
            s, m, a, e = above[k]
            options = [none]
            if text[j] == word:
                options.append((s + 2, m + 1, a if s else j, j + 1))
            elif s > 1:
                options.append((s - 1, m, a, e))
            s, m, a, e = above[k + 1]
            if s > 1:
                options.append((s - 1, m, a, e))
            if k:
                s, m, a, e = row[k - 1]
                if s > 1:
                    options.append((s - 1, m, a, e))
            row[k] = max(options)
            best = max(best, row[k])
        above = row
    return best[1], best[2], best[3]


def _every(template: np.ndarray, text: np.ndarray, low: int, high: int, need: float) -> list[tuple[int, int, int]]:
    """All matches of a band that do not overlap: the best one, then those in the text left and right of it."""
    out, parts = [], [(max(0, low), min(len(text), high + len(template)))]
    while parts:
        begin, stop = parts.pop()
        if stop - begin < need:
            continue
        got, first, end = align(template, text[begin:stop], low - begin, high - begin)
        if got >= need:
            out.append((got, begin + first, begin + end))
            parts += [(begin, begin + first), (begin + end, stop)]
    return out


def matches(index: Index, text: np.ndarray, hashes: np.ndarray, place: np.ndarray, least: float = LEAST) -> list[tuple[int, int, int, float]]:
    """(first word, end word, template, coverage) of every notice in a text, in order."""
    out = []
    for template, hits in index.candidates(hashes, place).items():
        hits.sort()
        groups = [[hits[0]]]
        for hit in hits[1:]:
            if hit[0] - groups[-1][-1][0] > BAND or hit[0] - groups[-1][0][0] > 4 * BAND:
                groups.append([])
            groups[-1].append(hit)
        words = index.words[template]
        found = set()
        for group in groups:
            found.update((first, end, template, got / len(words)) for got, first, end in _every(words, text, group[0][0] - BAND, group[-1][0] + BAND, least * len(words)))
        out += found
    # Of matches that overlap, the one with the most words matched stays, then the one with the largest coverage, then the longest.
    best = []
    for match in sorted(out, key=lambda m: (-round(m[3] * len(index.words[m[2]])), -m[3], m[0] - m[1], m)):
        if all(match[1] <= m[0] or m[1] <= match[0] for m in best):
            best.append(match)
    return sorted(best)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """All columns of ``docs`` plus ``licenses``: license, start, end and coverage of every notice, in order of place."""
    new = StructType.fromDDL("licenses array<struct<license:string,start:int,end:int,coverage:double>>")
    kept = [c for c in docs.columns if c not in new.names]
    frame, column = docs.select(*kept), kept.index(text_col)
    shared = frame.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def scanned(batches):
        index = shared.value
        for batch in batches:
            rows = []
            for block in W.blocks(batch.column(column)):
                found = W.words(block, W.NOT_ALNUM, W.LOWER)
                hashes, at = fingerprints(found)
                hit = np.isin(hashes, index.hashes)
                hashes, at = hashes[hit], at[hit]
                texts = found.text[at]
                here = [[] for _ in range(len(block))]
                points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)]) if len(at) else None
                for i in np.unique(texts).tolist():
                    mine = texts == i
                    low = int(found.first[i])
                    zero = int(points[block.bounds[i]])
                    for a, e, t, share in matches(index, found.hashes[low : found.first[i + 1]], hashes[mine], at[mine] - low, least):
                        here[i].append({"license": index.names[t], "start": int(points[found.starts[low + a]]) - zero, "end": int(points[found.ends[low + e - 1]]) - zero, "coverage": share})
                rows += here
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*kept, *new.names])

    return frame.mapInArrow(scanned, StructType(frame.schema.fields + new.fields))
