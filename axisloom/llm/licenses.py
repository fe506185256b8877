"""License notices found by patience alignment.

A text and a notice are sequences of lower-cased words. Words that occur once in both anchor the
alignment; the longest increasing subsequence of the anchors is kept, and each gap between them is
aligned the same way, after the words that agree at its two ends; a gap without anchors is aligned
by a longest common subsequence. The share of the notice's words that the alignment covers, within
a stretch of the text not much longer than the notice, decides.

Before any alignment an exact bound is applied to all texts at once: the aligned words are words of
the notice, so a text that holds fewer of them than the least coverage needs can't have it. In a
text that passes, whatever its length, a stretch can begin at each word of the notice; the same
bound and the longest common subsequence leave out those that can't cover enough, and each of the
others is aligned by itself, so what else the text holds doesn't matter.

Defined results: null texts count as empty; an empty text has no license; every input row keeps its
own row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches
from ._words import blocks, lower_table, split, word_hash

COVERAGE = 0.8  # least share of a notice's words
SPREAD = 1.5  # most words of the text that they lie in, for each word of the notice

# fixed values: notices, or the parts of longer license texts that are quoted
NOTICES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

def _inword() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[0x80:] = True
    return table


_INWORD = _inword()
_LOWER = lower_table()


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    return bytes(np.where(_INWORD[_LOWER[data]], _LOWER[data], 32).astype(np.uint8)).split()


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k:
            before[i] = ends[k - 1]
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def marks(notice) -> dict:
    """The places of each word, as the bits of a number."""
    out: dict = {}
    for j, w in enumerate(notice):
        out[w] = out.get(w, 0) | 1 << j
    return out


def common(text, at: dict, n: int) -> list[int]:
    """After each word of text, the places of a notice of n words (marked in at) where a longest common subsequence doesn't grow."""
    full = v = (1 << n) - 1
    out = [v]
    for w in text:
        if u := v & at.get(w, 0):
            v = (v + u | v - u) & full
        out.append(v)
    return out


def longest(text, notice) -> list[tuple[int, int]]:
    """Places in both of a longest common subsequence."""
    rows = common(text, marks(notice), len(notice))
    out, i, j = [], len(text), len(notice)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if rows[i] >> j - 1 & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def align(text, notice) -> list[tuple[int, int]]:
    """Aligned places (in text, in notice), increasing in both; the sequences hold comparable words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict = {}
        for i in range(c, d):
            once[notice[i]] = -1 if notice[i] in once else i
        at: dict = {}
        for i in range(a, b):
            if once.get(text[i], -1) >= 0:
                at[text[i]] = -1 if text[i] in at else i
        anchors = sorted((i, once[w]) for w, i in at.items() if i >= 0)
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:
            out += [(a + i, c + j) for i, j in longest(text[a:b], notice[c:d])]
            continue
        for (i, j), (k, l) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, l))
        out += anchors
    return sorted(out)


def tightest(pairs: list[tuple[int, int]], need: int, spread: float) -> tuple[int, int, int] | None:
    """(covered, start, end) of the stretch of aligned words that covers most with no more words of text than allowed."""
    best = None
    i = 0
    for k in range(len(pairs)):
        while pairs[k][0] - pairs[i][0] + 1 > spread:
            i += 1
        n = k - i + 1
        if n >= need and (best is None or n > best[0]):
            best = n, pairs[i][0], pairs[k][0] + 1
    return best


class Notices:
    def __init__(self, notices: dict[str, str], coverage: float, spread: float):
        self.names = list(notices)
        words = [words_of(t) for t in notices.values()]
        self.hashes = [np.array([word_hash(w) for w in x], np.uint64) for x in words]
        self.need = [max(1, int(np.ceil(coverage * len(x) - 1e-9))) for x in words]
        self.spread = [spread * len(x) for x in words]
        self.words = [h.tolist() for h in self.hashes]
        self.marks = [marks(x) for x in self.words]
        self.vocabulary = np.unique(np.concatenate(self.hashes))
        # words of each notice by their place in the vocabulary, with how often it has them
        self.bags = np.zeros((len(words), len(self.vocabulary)), np.int32)
        for k, h in enumerate(self.hashes):
            np.add.at(self.bags[k], np.searchsorted(self.vocabulary, h), 1)
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[self.vocabulary & np.uint64(0xFFFF)] = True

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """Notices of each text of a block."""
        w = split(data, offsets, _INWORD)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        at = np.flatnonzero(self.bitmap[w.hashes & np.uint64(0xFFFF)])
        place = np.searchsorted(self.vocabulary, w.hashes[at])
        place[place == len(self.vocabulary)] = 0
        hit = self.vocabulary[place] == w.hashes[at]
        at, place = at[hit], place[hit]
        text = np.searchsorted(w.first, at, side="right") - 1
        held = np.zeros((len(out), len(self.vocabulary)), np.int32)
        np.add.at(held, (text, place), 1)
        for k, bag in enumerate(self.bags):
            enough = np.minimum(held[:, bag > 0], bag[bag > 0]).sum(axis=1) >= self.need[k]
            for t in np.flatnonzero(enough).tolist():
                a, b = int(w.first[t]), int(w.first[t + 1])
                lo, hi = np.searchsorted(at, (a, b))
                own = bag[place[lo:hi]] > 0
                best = self.best(w.hashes[a:b], at[lo:hi][own] - a, place[lo:hi][own], k)
                if best:
                    out[t].append({"name": self.names[k], "coverage": best[0] / len(self.hashes[k]), "start": best[1], "end": best[2]})
        return out

    def starts(self, at: list[int], place: list[int], k: int) -> Iterator[tuple[int, int]]:
        """Places where stretches can begin, with the bound on what they cover; at and place are of the text's words of the notice."""
        width, need, bag = int(self.spread[k]), self.need[k], self.bags[k].tolist()
        held = dict.fromkeys(place, 0)
        shared = j = 0
        for i, p in enumerate(at):
            while j < len(at) and at[j] < p + width:
                shared += held[place[j]] < bag[place[j]]
                held[place[j]] += 1
                j += 1
            if shared >= need:
                yield p, shared
            held[place[i]] -= 1
            shared -= held[place[i]] < bag[place[i]]

    def best(self, hashes: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> tuple[int, int, int] | None:
        """(covered, start, end) of the stretch that covers most, the first of equals."""
        best, words = None, self.words[k]
        for p, bound in self.starts(at.tolist(), place.tolist(), k):
            least = best[0] + 1 if best else self.need[k]
            if bound < least:
                continue
            text = hashes[p : p + int(self.spread[k])].tolist()
            if len(words) - common(text, self.marks[k], len(words))[-1].bit_count() < least:
                continue
            found = tightest(align(text, words), least, self.spread[k])
            if found:
                best = found[0], p + found[1], p + found[2]
                if found[0] == len(words):
                    break
        return best


_FOUND = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(shared):
    def run(batches):
        notices: Notices = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(notices.found(data, offsets), _FOUND)], names=["doc_id", "licenses"])

    return run


def scan(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """doc_id and licenses: an array of (name, coverage, start, end) with the stretch's word places, in the notices' order."""
    bound_batches(docs.sparkSession)
    known = Notices(notices or NOTICES, coverage, spread)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(known)), "doc_id long, licenses array<struct<name:string,coverage:double,start:int,end:int>>")
