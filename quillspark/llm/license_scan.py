"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts become words (runs of ASCII letters and digits and of
non-ASCII bytes, lower-cased). Hashes of ``k`` words are winnowed: of every
``window`` successive hashes the least is kept, so any common run of
``k + window - 1`` words shares a fingerprint. The templates' fingerprints form
an inverted index, small and fixed by the templates alone, that travels with
the code; a text's fingerprints are looked up in it in one sorted search for a
whole batch. Hits of one template on near diagonals form a candidate, and a
local alignment in a band around them gives the share of the template's words
that the text has in order, and where. The words of a place found are barred
and what is left is aligned again, so copies side by side are each found.

The scan is a map over the texts: nothing is shuffled.

Defined results: null and empty texts match nothing; a text gets one row for
each place of each template with ``min_coverage`` or more, so a license twice
in a text gives two rows; repeated rows are reported each; of templates that
report overlapping spans, only those stay that no longer match contains; an
empty table gives no rows; columns beside id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Mapping
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License",
    "MIT-notice-2": "Licensed under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause-addition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Stands for the words of a place already found; no alignment crosses it.
BARRIER = 0xFFFFFFFFFFFFFFFF
#: A missing or added word costs this much of a match in the alignment.
GAP = 0.5


def words_of(buf: np.ndarray, off: np.ndarray):
    """Starts, ends, rows and hashes of the words."""
    starts, ends, rows = tc.word_spans(buf, off, _SEPARATOR)
    return starts, ends, rows, tc.SpanHash(buf)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def winnow(words: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word position and value of the winnowed ``k``-word hashes; windows never cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = tc.mix64(h * np.uint64(31) + words[j : j + n])
    inside = rows[:n] == rows[k - 1 :]
    h = np.where(inside, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    kept = np.zeros(n, dtype=bool)
    if n < window:
        for r in np.unique(rows[:n][inside]):
            own = np.flatnonzero((rows[:n] == r) & inside)
            kept[own[np.argmin(h[own])]] = True
    else:
        m = n - window + 1
        least = h[:m].copy()
        for j in range(1, window):
            np.minimum(least, h[j : j + m], out=least)
        for j in range(window):
            kept[j : j + m] |= h[j : j + m] == least
        kept &= inside
    at = np.flatnonzero(kept)
    return at, h[at]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: Mapping[str, str], k: int, window: int):
        self.k, self.window, self.names, self.words = k, window, list(templates), []
        values, owners, places = [], [], []
        for t, name in enumerate(self.names):
            buf = np.frombuffer(templates[name].lower().encode(), np.uint8)
            _, _, rows, words = words_of(buf, np.array([0, len(buf)]))
            self.words.append(words)
            # every hash of a template is indexed; winnowing thins the texts
            at, h = winnow(words, rows, k, 1)
            values.append(h)
            owners.append(np.full(len(h), t))
            places.append(at)
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.owner, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (owners, places))

    def hits(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word position in the text, template and word position in the template, for every match."""
        lo, hi = np.searchsorted(self.value, h, "left"), np.searchsorted(self.value, h, "right")
        n = hi - lo
        pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[pick], self.place[pick]


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with ``low <= text position - template position <= high``.

    Returns the number of matched words and the first and last matched text position.
    """
    text, template = text.tolist(), template.tolist()
    best, top = (0.0, 0, 0, -1), {}
    for i in range(len(template)):
        row = {}
        for j in range(max(0, i + low), min(len(text) - 1, i + high) + 1):
            if text[j] == BARRIER:
                continue
            s, m, first, last = 0.0, 0, j, -1
            if text[j] == template[i]:
                s, m, first, last = top.get(j - 1, (0.0, 0, j, -1))
                s, m, last = s + 1, m + 1, j
                first = j if m == 1 else first
            for other in (top.get(j), row.get(j - 1)):
                if other and other[0] - GAP > s:
                    s, m, first, last = other[0] - GAP, *other[1:]
            if s > 0:
                row[j] = (s, m, first, last)
                if s > best[0]:
                    best = row[j]
        top = row
    return best[1], best[2], best[3]


def places(words: np.ndarray, template: np.ndarray, at: np.ndarray, place: np.ndarray, k: int, band: int, min_coverage: float) -> list[tuple[int, int, int]]:
    """Matched words, first and last word of each place of a template; they don't overlap.

    The best alignment is taken, its words are barred and what is left is aligned again, until no hit is left. Hits
    on near diagonals are aligned together, in overlapping ranges of diagonals: an alignment has at most two added
    words for each matched one, so one range holds it whole, and many copies cost no more than their number.
    """
    order = np.argsort(at - place, kind="stable")
    at, diagonal = at[order], (at - place)[order]
    words, live = words.copy(), np.ones(len(at), dtype=bool)
    width, ranges = max(len(template), band), []
    for g in np.split(diagonal, np.flatnonzero(np.diff(diagonal) > band) + 1):
        for d in range(int(g[0]), max(int(g[0]), int(g[-1]) - 2 * width) + 1, width):
            ranges.append(np.searchsorted(diagonal, [d, min(int(g[-1]) + 1, d + 3 * width)]))
    spent: dict[int, np.ndarray] = {}
    poor: dict[int, list[tuple[int, int]]] = {}
    heap: list[tuple[int, int, int, int, int]] = []

    def push(r: int) -> None:
        lo, hi = ranges[r]
        mine = diagonal[lo:hi][live[lo:hi] & ~spent.get(r, np.zeros(hi - lo, dtype=bool))]
        if not len(mine):
            return
        low, high = int(mine[0]) - band, int(mine[-1]) + band
        base, stop = max(0, low), min(len(words), high + len(template))
        text = words[base:stop]
        if r in poor:
            text = text.copy()
            for a, b in poor[r]:
                text[max(0, a - base) : max(0, b + 1 - base)] = BARRIER
        m, first, last = align(text, template, low - base, high - base)
        if m:
            heappush(heap, (-m, last - first, first + base, last + base, r))

    for r in range(len(ranges)):
        push(r)
    out = []
    while heap:
        m, _, first, last, r = heappop(heap)
        if (words[first : last + 1] == BARRIER).any():  # another range's place has taken words since
            push(r)
        elif -m / len(template) >= min_coverage:
            out.append((-m, first, last))
            words[first : last + 1] = BARRIER
            live &= (at + k <= first) | (at > last)
            push(r)
        else:
            lo, hi = ranges[r]
            inside = (at[lo:hi] + k > first) & (at[lo:hi] <= last)
            before = spent.get(r, np.zeros(hi - lo, dtype=bool))
            spent[r] = before | inside
            poor.setdefault(r, []).append((first, last))
            if (inside & ~before & live[lo:hi]).any():
                push(r)
    return out


def find(words: np.ndarray, index: Index, at: np.ndarray, owner: np.ndarray, place: np.ndarray, band: int, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """Template, matched words, first and last word of every match in one text."""
    out = []
    for t in np.unique(owner):
        mine = owner == t
        out += [(int(t), *x) for x in places(words, index.words[t], at[mine], place[mine], index.k, band, min_coverage)]
    kept: dict[int, list[tuple[int, int, int]]] = {}  # places of one template are disjoint: the last that begins before may hold another
    for t, m, first, last in sorted(out, key=lambda x: (-x[1], x[2], x[0])):
        if not any(n and x[n - 1][1] >= last for x in kept.values() for n in [bisect_right(x, (first, len(words)))]):
            insort(kept.setdefault(t, []), (first, last, m))
    return sorted(((t, m, a, b) for t, x in kept.items() for a, b, m in x), key=lambda x: (x[2], x[0]))


_OUT = "doc_id long, license string, coverage double, matched_words int, start_byte int, end_byte int"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, k: int = 3, window: int = 2, band: int = 12, min_coverage: float = 0.8) -> DataFrame:
    """One row per license found: its coverage and matched words, and the span of bytes in the text."""
    index = Index(templates, k, window)
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null and t <> ''")

    @tc.tidy
    def run(batches):
        for batch in batches:
            for part in tc.slices(batch, "t", 1_000_000):
                # ASCII case only: positions in the text stay those of its own bytes
                buf, off = tc.buffers(part.column("t"))
                upper = (buf >= 65) & (buf <= 90)
                starts, ends, rows, words = words_of(buf + upper.astype(np.uint8) * np.uint8(32), off)
                at, h = winnow(words, rows, index.k, index.window)
                at, owner, place = index.hits(at, h)
                if not len(at):
                    continue
                ids, out = part.column("i").to_pylist(), []
                first = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for r in np.unique(rows[at]):
                    mine = rows[at] == r
                    lo, hi = first[r], first[r + 1]
                    for t, m, a, b in find(words[lo:hi], index, at[mine] - lo, owner[mine], place[mine], band, min_coverage):
                        out.append((ids[r], index.names[t], round(m / len(index.words[t]), 6), m, int(starts[lo + a] - off[r]), int(ends[lo + b] - off[r])))
                if out:
                    types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "license", "coverage", "matched_words", "start_byte", "end_byte"])

    return base.mapInArrow(run, _OUT)
