"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts are lower-cased, and all ASCII but letters and digits counts as blank, so comment signs and line breaks don't
matter.  A template of ``n`` five-word shingles looks at windows of two neighbouring blocks of ``s`` shingles, ``s`` the
power of two from ``n`` up: any run of ``n`` shingles lies whole in one of them.  A window that holds 0.8 of a template
has a Jaccard similarity of at least ``0.8 n / (2 s + 0.2 n)`` to it, over 0.19 as ``s < 2 n``.  Bands have one row,
so with 48 bands such a window is retrieved with a probability over ``1 - 0.81 ** 48``, or 0.99995.  Each band's table is
sorted by value: a window looks its own value up, whatever the number of templates.  A retrieved window matches if it holds at least 0.8 of the template's distinct shingles; nothing else decides.

Matches of a template in windows that overlap are one span, from the first to the last of its shingles there.

Defined results: a null text counts as empty; texts under five words hold nothing; an empty table gives an empty result;
repeated rows give equal rows; columns beside the two named are never read.  Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import LETTERS, Words, map_chunks, mixed, whole_text

SHINGLE, CONTAINED, BANDS = 5, 0.8, 48

#: Short notices, openings of well-known license texts, and the shorter of the texts themselves.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
}


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk, and where each row's begin; shingle ``k`` of a row starts at its word ``k``."""
    h = words.hashes()
    counts = np.maximum(np.diff(words.bounds) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    whole = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        whole = whole * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(whole)]
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], counts)
    return mixed(whole[at]), bounds


def _band_hashes(h: np.ndarray, band: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + band)
    a, b = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    return (h * (a * np.uint64(2) + np.uint64(1)) + b) >> np.uint64(32)


class Index:
    """The templates by block size: their distinct shingles and their band values."""

    def __init__(self, templates: dict[str, list[str]], bands: int = BANDS):
        self.bands, self.by_size = bands, {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                own = np.unique(shingle_hashes(Words(pa.array([text]), LETTERS))[0])
                if not len(own):
                    raise ValueError(f"{name}: a template needs {SHINGLE} words")
                size = 1 << (len(own) - 1).bit_length()
                mins = np.array([_band_hashes(own, k).min() for k in range(bands)], np.uint64)
                self.by_size.setdefault(size, []).append((name, own, mins))
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size, entries in self.by_size.items():
            for band in range(bands):
                values = np.array([mins[band] for _, _, mins in entries], np.uint64)
                order = np.argsort(values, kind="stable")
                self.tables[size, band] = values[order], order

    def candidates(self, size: int, band: int, values: np.ndarray) -> np.ndarray:
        """Window numbers and template numbers, packed, of equal band values."""
        table, order = self.tables[size, band]
        low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
        at = np.flatnonzero(high > low)
        n = (high - low)[at]
        place = np.arange(n.sum()) + np.repeat(low[at] - (np.cumsum(n) - n), n)
        return np.repeat(at, n) << 20 | order[place]


def found(words: Words, index: Index, contained: float = CONTAINED) -> list[list[tuple[str, int, int, float]]]:
    """For each row its spans: license, start and end byte, and the highest containment in it."""
    h, bounds = shingle_hashes(words)
    rows = len(bounds) - 1
    out: list[list] = [[] for _ in range(rows)]
    if not len(h):
        return out
    counts = np.diff(bounds)
    layout = {}
    for size in sorted(index.by_size):  # blocks never cross rows; the window of a row's last block is that block alone
        blocks = -(-counts // size)
        first = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(bounds[:-1], blocks) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) * size
        last = np.zeros(first[-1], bool)
        last[first[1:][blocks > 0] - 1] = True
        layout[size] = (starts, last, [])
    for band in range(index.bands):
        values = _band_hashes(h, band)
        for size, (starts, last, met) in layout.items():
            least = values if size == 1 else np.minimum.reduceat(values, starts)
            pair = np.where(last, least, np.minimum(least, np.concatenate([least[1:], least[-1:]])))
            met.append(index.candidates(size, band, pair))
    row_of = np.repeat(np.arange(rows), counts)
    for size, (starts, _, met) in layout.items():
        met = np.unique(np.concatenate(met))  # by window, so that a template's spans come in order
        template = met & ((1 << 20) - 1)
        for t in np.unique(template).tolist():
            name, own, _ = index.by_size[size][t]
            spans: dict[int, list] = {}
            for block in (met[template == t] >> 20).tolist():
                row = int(row_of[starts[block]])
                a, b = int(starts[block]), min(int(starts[block]) + 2 * size, int(bounds[row + 1]))
                inside = np.flatnonzero(np.isin(h[a:b], own))
                share = len(np.unique(h[a:b][inside])) / len(own)
                if share < contained:
                    continue
                word = words.bounds[row] - bounds[row]
                start, end = int(words.starts[word + a + inside[0]]), int(words.ends[word + a + inside[-1] + SHINGLE - 1])
                own_spans = spans.setdefault(row, [])
                if own_spans and start < own_spans[-1][1]:
                    own_spans[-1] = (own_spans[-1][0], max(end, own_spans[-1][1]), max(share, own_spans[-1][2]))
                else:
                    own_spans.append((start, end, share))
            for row, own_spans in spans.items():
                base = int(words.offsets[row])
                out[row] += [(name, a - base, b - base, x) for a, b, x in own_spans]
    return [sorted(x, key=lambda s: (s[1], s[2], s[0])) for x in out]


def scanned(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """Per document: id, ``licenses`` (sorted names), ``n_spans`` and ``spans`` (license, start, end, containment)."""

    def make():
        index = Index(templates)

        def work(batch: pa.RecordBatch) -> dict:
            rows = found(Words(batch.column("_text"), LETTERS), index, contained)
            return {
                "_id": batch.column("_id"),
                "licenses": [sorted({s[0] for s in x}) for x in rows],
                "n_spans": [len(x) for x in rows],
                "spans": [[{"license": n, "start": a, "end": b, "containment": round(c, 6)} for n, a, b, c in x] for x in rows],
            }

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, licenses array<string>, n_spans long, spans array<struct<license:string,start:long,end:long,containment:double>>"
    return map_chunks(source, make, shape, "_text").withColumnRenamed("_id", id)
