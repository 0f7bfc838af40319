"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template is a notice of ``shingle`` words or more; its set holds its word shingles (shorter ones are one shingle). Windows
of a template's length slide over a text by an eighth of it, so some window covers any occurrence but an eighth; a window
twice as long would hold it whole but dilute its similarity, and this one keeps 0.8 or more of the shingles of an occurrence
that itself holds at least 0.9 of the template. Templates of one length share their windows. Each window's MinHash sketch has
``BANDS`` bands of ``ROWS`` registers: at similarity 0.6 a template is missed with a chance of (1 - 0.6**2)**32, below 1e-6.
A retrieved window is widened by a quarter to either side, and the share of the template's shingles found there is its
containment; matches need ``LEAST``. To keep sketches off texts that cannot match, only windows that hold a template's shingle
at all are sketched.

Templates are a dictionary or a table (name, text) of the caller's, or those below; their size is checked before they are sent
out. Null and empty texts and null templates have no matches, equal templates under two names match both, repeated rows are kept,
and an empty table gives no rows. Other columns are ignored. A text takes some 60 bytes of memory for each of its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.words import ALNUM, U, mix, runs, sliced, small_batches, whole, words
from strandmill.session import ship

SHINGLE, BANDS, ROWS, LEAST, MOST_BYTES = 5, 32, 2, 0.8, 8 << 20

# Short notices of common licenses, as their publishers ask for them, and one-line statements.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _set(h: np.ndarray, shingle: int) -> np.ndarray:
    if 0 < len(h) < shingle:
        return np.array([whole(h, shingle)], np.uint64)
    return runs(h, np.array([0, len(h)]), shingle)[0]


def _registers(h: np.ndarray, n: int) -> np.ndarray:
    """[n, len(h)] values of n hash functions."""
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return mix(h[None, :] ^ seeds[:, None])


def _bands(least: np.ndarray) -> np.ndarray:
    """Bucket names of sketches [n, windows], as [bands, windows]."""
    groups = least.reshape(-1, ROWS, least.shape[1])
    h = np.arange(len(groups), dtype=np.uint64)[:, None] * U(0xA24BAED4963EE407)
    for i in range(ROWS):
        h = mix(h + groups[:, i])
    return h


def _shortest(h: np.ndarray, where: np.ndarray) -> tuple[int, int]:
    """The first and last place of the shortest range, the leftmost of these, that holds every hash of h; h[i] lies at where[i]."""
    need, count, best, left = len(np.unique(h)), {}, None, 0
    for right, x in enumerate(h.tolist()):
        count[x] = count.get(x, 0) + 1
        while len(count) == need:
            if best is None or where[right] - where[left] < best[1] - best[0]:
                best = (int(where[left]), int(where[right]))
            y = int(h[left])
            count[y] -= 1
            if not count[y]:
                del count[y]
            left += 1
    return best


def _apart(rows: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int]]:
    """(-share, start, end) of rows (-share, window, start, end) in their order, without those that overlap one before."""
    starts, kept = [], []
    for c, _, a, b in sorted(rows):
        i = bisect.bisect(starts, (a, b))
        if (i == 0 or starts[i - 1][1] <= a) and (i == len(starts) or b <= starts[i][0]):
            starts.insert(i, (a, b))
            kept.append((c, a, b))
    return kept


class Index:
    def __init__(self, templates: dict[str, str], shingle: int, least: float) -> None:
        if sum(len(t.encode()) for t in templates.values()) > MOST_BYTES:
            raise ValueError(f"templates hold more than {MOST_BYTES} bytes: scan in several calls")
        self.shingle, self.least = shingle, least
        w = words(pa.array(list(templates.values())), ALNUM, lower=True)
        self.names = list(templates)
        own = [w.hash[a:b] for a, b in zip(w.docs, w.docs[1:], strict=False)]
        self.sets = [np.unique(_set(h, shingle)) for h in own]
        self.length = [len(h) for h in own]
        self.every = np.unique(np.concatenate([s for s, n in zip(self.sets, self.length, strict=True) if n >= shingle] or [np.zeros(0, np.uint64)]))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.every >> U(44)] = True
        # by length: bucket -> templates
        self.by: dict[int, dict[int, list[int]]] = {}
        for i, (s, n) in enumerate(zip(self.sets, self.length, strict=True)):
            if n >= shingle:
                buckets = self.by.setdefault(n, {})
                for b in _bands(_registers(s, BANDS * ROWS).min(axis=1)[:, None])[:, 0].tolist():
                    buckets.setdefault(b, []).append(i)
        self.short = {int(s[0]): [j for j, m in enumerate(self.length) if 0 < m < shingle and int(self.sets[j][0]) == int(s[0])] for s, n in zip(self.sets, self.length, strict=True) if 0 < n < shingle}

    def found(self, h: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of the matches of each template in a text's words that overlap none of its
        better ones: the best first, then the earlier."""
        every: dict[int, list[tuple[float, int, int, int]]] = {}
        n = len(h)
        s = _set(h, self.shingle) if n >= self.shingle else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.bits[s >> U(44)]) if len(s) else np.zeros(0, np.int64)
        at = at[np.isin(s[at], self.every)]
        for length, buckets in self.by.items() if len(at) else ():
            step, width = max(1, length // 8), length - self.shingle + 1
            # the window starts, all multiples of step, whose windows hold a marked shingle
            starts = np.unique(np.concatenate([at // step * step - k * step for k in range(-(-width // step) + 1)]))
            starts = starts[(starts >= 0) & (starts < len(s))]
            tried = set()
            for i in range(0, len(starts), 256):
                block = starts[i : i + 256]
                place = np.minimum(block[:, None] + np.arange(width), len(s) - 1)
                uniq, back = np.unique(s[place], return_inverse=True)
                least = _registers(uniq, BANDS * ROWS)[:, back.reshape(place.shape)].min(axis=2)
                for bucket_row in _bands(least):
                    for p, b in zip(block.tolist(), bucket_row.tolist(), strict=True):
                        for t in buckets.get(b, ()):
                            tried.add((p, t))
            for p, t in sorted(tried):
                a, b = max(0, p - length // 4 - 1), min(len(s), p + width + length // 4 + 1)
                inside = np.isin(s[a:b], self.sets[t])
                share = len(np.unique(s[a:b][inside])) / len(self.sets[t])
                where = np.flatnonzero(inside)
                if share >= self.least:
                    first, last = int(where[0]), int(where[-1])
                    if last - first + self.shingle > length:  # a neighbour's shingles may lie in the widened window
                        first, last = _shortest(s[a:b][where], where)
                    every.setdefault(t, []).append((-share, p, a + first, a + last + self.shingle))
        out = [(t, a, b, -c) for t, rows in every.items() for c, a, b in _apart(rows)]
        for t in {t for ts in self.short.values() for t in ts}:
            m = self.length[t]
            k = np.array([int(self.sets[t][0])], np.uint64)
            if n >= m:
                hits = [i for i in range(n - m + 1) if _set(h[i : i + m], self.shingle)[0] == k[0]]
                out += [(t, a, b, 1.0) for _, a, b in _apart([(-1.0, i, i, i + m) for i in hits])]
        return sorted(out)


FOUND = "doc_id long, n_words long, matches array<struct<license:string,start:long,end:long,containment:double>>"


def _given(templates: DataFrame) -> dict[str, str]:
    rows = templates.select(F.col("name").cast("string").alias("name"), "text").where("name is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"templates hold more than {MOST_BYTES} bytes: scan in several calls")
    return {r["name"]: r["text"] for r in rows.orderBy("name", "text").collect()}


def licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, n_words and the matches of each license that do not overlap (word positions, end exclusive), by name and start."""
    ship(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = _given(templates)
    index = Index(templates if templates is not None else TEMPLATES, shingle, least)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in sliced(batches, "text"):
            w = words(b.column("text"), ALNUM, lower=True)
            # texts without any shingle of a template are passed over together
            s, at = runs(w.hash, w.docs, own.shingle)
            hit = at[own.bits[s >> U(44)]] if len(s) else at
            marked = np.zeros(b.num_rows, bool)
            marked[np.searchsorted(w.docs, hit, "right") - 1] = True
            if own.short:
                marked[:] = True
            rows = []
            for i in range(b.num_rows):
                got = own.found(w.hash[w.docs[i] : w.docs[i + 1]]) if marked[i] else []
                rows.append([{"license": own.names[t], "start": p, "end": q, "containment": c} for t, p, q, c in sorted(got, key=lambda x: (own.names[x[0]], x[1]))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count(), pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "matches"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, FOUND)
