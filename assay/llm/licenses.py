"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates become lower-case words without ASCII punctuation, then shingles of five words. Templates fall into
classes by their number of shingles, in powers of two. For a class of c shingles a text is cut into windows of c + hop - 1
shingles, one every hop = max(1, c // 2), so each run of c shingles lies whole in one window. Each band is one MinHash
value (one row a band); a class takes as many bands as make a window that holds `threshold` of a template's shingles
collide with it with a probability of at least RECALL. Retrieved pairs are verified by exact containment in the window.

The work needs no shuffle: every text is scanned where it is read. Templates go to the executors as a table whose size is
bounded by MAX_TEMPLATES.

Templates of fewer than five words have one shingle of their own length; they are found where these words stand in a row.
Of templates that match in one place, with `best`, the one with the largest containment counts, and of equal ones the longest: a header
that differs from another by a version or a word does not bring the other's name along.

Null text is the empty text. A text without licenses has none listed. Repeated rows are scanned row by row; an empty table
gives an empty result. Other columns play no part. Of templates of one name the best match counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, text_blocks, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_TEMPLATES = 20_000
SEED = 42

# License notices and texts as they are published, by SPDX name where there is one.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
)

_to_space = bytes.maketrans(b"", b"").translate(bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)))


def words(texts: list[bytes]) -> Words:
    return Words([t.translate(_to_space) for t in texts], SHINGLE)


def bands(window: int, shingles: int, threshold: float, recall: float = RECALL) -> int:
    """How many one-row bands a window needs that holds `threshold` of a template's shingles."""
    need = math.ceil(threshold * shingles - 1e-9)
    j = need / (window + shingles - need)
    return 1 if j >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - j))


@dataclass
class Class:
    window: int
    hop: int
    names: list[str]
    shingles: list[np.ndarray]
    #: by band: the templates' MinHash values in order, and whose they are
    values: list[np.ndarray]
    owners: list[np.ndarray]


def _mix(h: np.ndarray, band: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, band])
    a, b = rng.integers(0, 2**64, 2, np.uint64)
    x = (h ^ b) * (a | np.uint64(1))
    return x ^ (x >> np.uint64(29))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD, best: bool = False):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.threshold, self.classes, self.best = threshold, [], best
        w = words([t.encode() for _, t in templates])
        #: By number of words below five: the names of each hash, and the hashes in order.
        self.short: dict[int, tuple[dict[int, list[str]], np.ndarray]] = {}
        for k in sorted({int(n) for n in w.n_words if 0 < n < SHINGLE}):
            name_of: dict[int, list[str]] = {}
            for (name, text), n in zip(templates, w.n_words, strict=True):
                if n == k:
                    h = int(Words([text.encode().translate(_to_space)], k).row_hashes(SEED)[1][0])
                    name_of.setdefault(h, []).append(name)
            self.short[k] = (name_of, np.array(sorted(name_of), np.uint64))
        offsets, hashes = w.row_hashes(SEED)
        sets = [np.unique(hashes[a:b]) if n >= SHINGLE else np.zeros(0, np.uint64) for a, b, n in zip(offsets[:-1], offsets[1:], w.n_words, strict=True)]
        sizes = [1 << max(0, (len(s) - 1).bit_length()) for s in sets]
        for c in sorted({n for n, s in zip(sizes, sets, strict=True) if len(s)}):
            own = [i for i, n in enumerate(sizes) if n == c and len(sets[i])]
            hop = max(1, c // 2)
            window = c + hop - 1
            n = max(bands(window, len(sets[i]), threshold) for i in own)
            values, owners = [], []
            for band in range(n):
                v = np.array([_mix(sets[i], band).min() for i in own], np.uint64)
                order = np.argsort(v, kind="stable")
                values.append(v[order])
                owners.append(order)
            self.classes.append(Class(window, hop, [templates[i][0] for i in own], [sets[i] for i in own], values, owners))

    def _candidates(self, c: Class, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, mixed: dict[int, np.ndarray]) -> np.ndarray:
        """Distinct (window, template) pairs that share a MinHash value."""
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[::2], bounds[1::2] = starts, ends
        found = []
        for band, (values, owners) in enumerate(zip(c.values, c.owners, strict=True)):
            x = mixed.get(band)
            if x is None:
                x = mixed[band] = np.r_[_mix(hashes, band), np.uint64(0)]
            low = np.minimum.reduceat(x, bounds)[::2] if c.window > 1 else x[starts]
            at = np.searchsorted(values, low)
            hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == low)
            for w in hit.tolist():
                k = int(at[w])
                while k < len(values) and values[k] == low[w]:
                    found.append((w, int(owners[k])))
                    k += 1
        return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)

    def scan(self, texts: list[bytes]) -> list[dict[str, float]]:
        """For each text the containment of the licenses found in it, with `best` without rivals."""
        out: list[dict[str, float]] = [{} for _ in texts]
        for a, b in text_blocks(texts, 2_000_000):
            w = words(texts[a:b])
            offsets, hashes = w.row_hashes(SEED)
            if not len(hashes):
                continue
            found: list[tuple[int, int, int, int, float, str]] = []  # row, place, end, shingles, share, name
            mixed: dict[int, np.ndarray] = {}
            for c in self.classes:
                n = -(-np.diff(offsets) // c.hop)
                row = np.repeat(np.arange(b - a), n)
                starts = offsets[row] + c.hop * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                ends = np.minimum(starts + c.window, offsets[row + 1])
                for i, t in self._candidates(c, hashes, starts, ends, mixed).tolist():
                    span = hashes[starts[i] : ends[i]]
                    share = float(np.isin(c.shingles[t], span).mean())
                    if share >= self.threshold - 1e-9:
                        at = np.flatnonzero(np.isin(span, c.shingles[t]))
                        found.append((int(row[i]), int(starts[i] + at[0]), int(starts[i] + at[-1]) + 1, len(c.shingles[t]), share, c.names[t]))
            for k, (name_of, keys) in self.short.items():
                short = Words([x.translate(_to_space) for x in texts[a:b]], k)
                o, h = short.row_hashes(SEED)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == h).tolist():
                    r = int(np.searchsorted(o, i, "right")) - 1
                    if short.n_words[r] >= k:
                        # in shingles of five words a short one's place is the same but at the end of a text
                        p = int(offsets[r]) + min(i - int(o[r]), max(int(offsets[r + 1] - offsets[r]) - 1, 0))
                        found += [(r, p, p + 1, 1, 1.0, name) for name in name_of[int(h[i])]]
            self._keep(found, out, a)
        return out

    def _keep(self, found: list[tuple[int, int, int, int, float, str]], out: list[dict[str, float]], base: int) -> None:
        """Of rivals, which are matches of different names that overlap by half of the shorter one, only the best stays."""
        by_row: dict[int, list[tuple[int, int, int, float, str]]] = {}
        for r, *rest in found:
            by_row.setdefault(r, []).append(tuple(rest))
        for r, matches in by_row.items():
            kept: list[tuple[int, int, int, float, str]] = []
            for m in sorted(set(matches), key=lambda m: (-m[3], -m[2], m[4], m[0])):
                rival = self.best and any(k[4] != m[4] and 2 * (min(k[1], m[1]) - max(k[0], m[0])) >= min(k[1] - k[0], m[1] - m[0]) for k in kept)
                if not rival:
                    kept.append(m)
            best = out[base + r]
            for *_, share, name in kept:
                best[name] = max(best.get(name, 0.0), share)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, best: bool = True) -> DataFrame:
    """(id_col, n_licenses, licenses, containments) for every row of docs: names in order, containments beside them."""
    scanner = Scanner(list(templates or TEMPLATES), threshold, best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scanner.scan(batch.column(1).to_pylist())
            names = [sorted(f) for f in found]
            shares = [[f[k] for k in ks] for f, ks in zip(found, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(k) for k in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["id", "n", "names", "shares"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, names array<string>, shares array<double>").toDF(id_col, "n_licenses", "licenses", "containments")
