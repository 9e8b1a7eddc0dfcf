"""License scans: MinHash bands find templates, shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.kernels import mix, pieces, utf8
from grainsift.llm._common import Words, keep_columns, prepare, rolling, sliding_min, table, tidied

SHINGLE = 3
ROWS = 2
CONTAINMENT = 0.8
RECALL = 0.995
"""Bands are as many as give this probability of a collision, for each template size."""
TEMPLATE_BYTES = 16 << 20
"""Templates are sent to workers in parts of at most this size, a pass each."""
_SEED = np.uint64(0xD6E8FEB86659FD93)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-short": "Released under the MIT License.",
    "Apache-short": "Licensed under the Apache License, Version 2.0.",
    "All-rights-reserved": "Copyright. All rights reserved.",
    # short notices, without what varies (verbs, versions): all forms hold them whole
    "Rights-reserved-short": "All rights reserved.",
    "MIT-licensed-short": "Licensed under the MIT License.",
    "GPL-short": "under the GNU General Public License",
    "LGPL-short": "under the GNU Lesser General Public License",
    "AGPL-short": "under the GNU Affero General Public License",
    "MPL-short": "under the Mozilla Public License",
    "BSD-short": "under the BSD License",
    "BSD-2-Clause-short": "under the BSD 2-Clause License",
    "BSD-3-Clause-short": "under the BSD 3-Clause License",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-short": "under the Unlicense",
    "CC-BY-NC-short": "Licensed under CC BY-NC",
    "CC-BY-SA-short": "Licensed under CC BY-SA",
    "CC-BY-ND-short": "Licensed under CC BY-ND",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-3.0-short": "Licensed under CC BY 3.0",
}


def collision(similarity: float, rows: int, bands: int) -> float:
    """Probability that a pair of this Jaccard similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


@dataclass(frozen=True)
class Scale:
    """Windows for templates of ``low < shingles <= high``: ``blocks`` blocks of
    ``step`` shingles, one at every block, so that some window holds any occurrence
    whole; and the bands that this similarity needs."""

    low: int
    high: int
    bands: int = 0

    @property
    def step(self) -> int:
        return max(1, self.high // 4)

    @property
    def blocks(self) -> int:
        return -(-self.high // self.step) + 1

    def least_similarity(self, containment: float) -> float:
        """Of a template and a window that just holds enough of it."""
        return min(math.ceil(containment * m - 1e-9) / (self.blocks * self.step + m - math.ceil(containment * m - 1e-9)) for m in range(self.low + 1, self.high + 1))


def scales(sizes: list[int], rows: int, containment: float, recall: float) -> list[Scale]:
    """Sizes in steps of a quarter, those of the templates only."""
    if not (0 < containment <= 1 and 0 < recall < 1 and rows >= 1):
        raise ValueError("containment lies in (0, 1], recall between 0 and 1, and a band has a row")
    spans: list[list[int]] = []
    for high in sorted(set(sizes)):
        if spans and high <= 1.25 * (spans[-1][0] + 1):
            spans[-1][1] = high
        else:
            spans.append([high - 1, high])
    out = []
    for low, high in spans:
        s = Scale(low, high).least_similarity(containment)
        out.append(Scale(low, high, max(1, math.ceil(math.log(1 - recall) / math.log(1 - s**rows))) if s < 1 else 1))
    return out


class Library:
    """Templates as sets of shingles, with the band keys of their signatures."""

    def __init__(self, templates: dict[str, str], rows: int = ROWS, containment: float = CONTAINMENT, recall: float = RECALL):
        self.rows, self.containment = rows, containment
        self.names = sorted(templates)
        self.shingles = [shingles_of(templates[n]) for n in self.names]
        sizes = [len(s) for s in self.shingles]
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.every & np.uint64(0xFFFF)] = True
        self.scales = scales([n for n in sizes if n], rows, containment, recall)
        self.functions = rows * max((s.bands for s in self.scales), default=0)
        #: for each scale and band: keys in order, their templates, and a filter on 16 bits
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for s in self.scales:
            own = np.array([i for i, n in enumerate(sizes) if s.low < n <= s.high])
            least = np.stack([minima(self.shingles[i], self.functions).min(axis=1) for i in own], axis=1)
            bands = []
            for b in range(s.bands):
                key = band_key(least[b * rows : (b + 1) * rows])
                order = np.argsort(key, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[key & np.uint64(0xFFFF)] = True
                bands.append((key[order], own[order], sieve))
            self.tables.append(bands)


def shingles_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(rolling(Words(data, np.array([0, len(data)])).hashes, SHINGLE))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` 32-bit hashes of each shingle, a row for each hash function."""
    out = np.empty((n, len(shingles)), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            # multiply-shift by an odd constant that splitmix64 gives
            factor = mix(np.array([_SEED * np.uint64(i + 1)], np.uint64))[0] | np.uint64(1)
            out[i] = (shingles * factor) >> np.uint64(32)
    return out


def band_key(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key of the minima in a band; of two exactly both."""
    key = rows[0].astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in rows[1:]:
            key = (key << np.uint64(32) | key >> np.uint64(32)) * np.uint64(1 if len(rows) == 2 else 0x9E3779B97F4A7C15) ^ r
    return key


def scan(library: Library, words: Words) -> Iterator[tuple[int, int, int, float, int]]:
    """(text, template, first word, containment, windows) for each template that a
    text holds; of several windows the fullest, then the first."""
    h = rolling(words.hashes, SHINGLE)
    owner = words.owner()
    whole = owner[: len(h)] == owner[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    place = np.flatnonzero(whole)
    h = h[whole]
    # a window collides in a band only if it holds the template's shingles with the least
    # hashes: a text without any shingle of a template has no such window
    some = np.flatnonzero(library.sieve[h & np.uint64(0xFFFF)])
    some = some[np.isin(h[some], library.every)]
    if not len(some):
        return
    of = owner[: len(whole)][whole]
    near = np.zeros(len(words.first) - 1, bool)
    near[of[some]] = True
    near = near[of]
    place, h = place[near], h[near]
    first = np.searchsorted(place, words.first)
    hashes = minima(h, library.functions)
    size = np.diff(first)
    for scale, tables in zip(library.scales, library.tables, strict=True):
        step, blocks = scale.step, scale.blocks
        # blocks begin anew with each text; a text shorter than a window is one
        count = -(-size // step)
        begin = np.r_[0, np.cumsum(count)]
        windows = np.where(count > 0, np.maximum(1, count - blocks + 1), 0)
        text = np.repeat(np.arange(len(size)), windows)
        k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = begin[text] + k
        high = np.minimum(low + blocks, begin[text + 1])
        full = high - low == blocks
        starts = first[np.repeat(np.arange(len(size)), count)] + (np.arange(begin[-1]) - np.repeat(begin[:-1], count)) * step
        hits: set[tuple[int, int]] = set()
        for b, (keys, which, sieve) in enumerate(tables):
            signature = np.empty((library.rows, len(low)), np.uint32)
            for r in range(library.rows):
                row = hashes[b * library.rows + r]
                least = row if step == 1 else np.minimum.reduceat(row, starts)
                if len(least) >= blocks:
                    signature[r, full] = sliding_min(least, blocks)[low[full]]
                if not full.all():
                    signature[r, ~full] = _reduce_min(least, low[~full], high[~full])
            key = band_key(signature)
            some = np.flatnonzero(sieve[key & np.uint64(0xFFFF)])
            left, right = np.searchsorted(keys, key[some]), np.searchsorted(keys, key[some], "right")
            for w, x, y in zip(some[right > left], left[right > left], right[right > left], strict=True):
                hits |= {(int(w), int(t)) for t in which[x:y]}
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for w, t in sorted(hits):
            known, x = library.shingles[t], int(text[w])
            start = int(first[x] + k[w] * step)
            held = np.isin(known, h[start : min(start + blocks * step, first[x + 1])]).sum() / len(known)
            if held >= library.containment:
                old = best.get((x, t))
                n = (old[2] if old else 0) + 1
                best[x, t] = (held, start, n) if old is None or held > old[0] else (old[0], old[1], n)
        for (x, t), (held, at, n) in sorted(best.items()):
            yield x, t, int(place[at] - words.first[x]), float(held), n


def _reduce_min(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.minimum.reduceat(row, np.stack([start, np.minimum(end, len(row) - 1)], axis=1).ravel())[::2]
    at_end = end == len(row)  # reduceat can't name the place behind the last entry
    out[at_end] = np.minimum(out[at_end], row[-1])
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, rows: int = ROWS, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """``(doc_id, license, first_word, containment, windows)``: every template of
    which a window of the text holds at least ``containment`` of the shingles.

    Windows overlap so that one holds any occurrence whole, at a size that follows
    the template's. Banded MinHash retrieves templates, with so many bands that a
    window with just the containment asked for collides with probability ``recall``;
    the exact share of shingles then decides. One scan over whole
    texts, no shuffle; templates go to workers in parts of bounded size, a scan
    each. Null and empty texts and those of under three words hold nothing, nor do
    such templates. Repeated rows give repeated results, null ids stay null; an
    occurrence that several windows hold is one row (ties: the first window).
    An empty table gives none. ValueError for a containment or a recall that isn't
    a share.
    """
    prepare(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    groups: list[dict[str, str]] = [{}]
    size = 0
    for name in sorted(templates):
        if groups[-1] and size + len(templates[name]) > TEMPLATE_BYTES:
            groups.append({})
            size = 0
        groups[-1][name] = templates[name]
        size += len(templates[name])
    source = keep_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for group in groups:
        library = docs.sparkSession.sparkContext.broadcast(Library(group, rows, containment, recall))

        @tidied
        def run(batches: Iterator[pa.RecordBatch], library=library) -> Iterator[pa.RecordBatch]:
            known = library.value
            for batch in batches:
                raw, offsets = utf8(batch.column(1))
                for i, j in pieces(offsets, 1 << 20):
                    words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    rows = list(scan(known, words))
                    yield pa.record_batch(
                        [
                            batch.column(0).slice(i, j - i).take(pa.array([r[0] for r in rows], pa.int64())),
                            pa.array([known.names[r[1]] for r in rows], pa.string()),
                            pa.array([r[2] for r in rows], pa.int64()),
                            pa.array([r[3] for r in rows], pa.float64()),
                            pa.array([r[4] for r in rows], pa.int64()),
                        ],
                        ["doc_id", "license", "first_word", "containment", "windows"],
                    )

        part = source.mapInArrow(run, "doc_id long, license string, first_word long, containment double, windows long")
        found = part if found is None else found.unionByName(part)
    return found


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
