"""License scans: MinHash bands over overlapping windows retrieve templates, containment decides.

A template's shingles are its runs of five words (lower case in A-Z); one of fewer words is a
single shingle. For every number of shingles that a template has, a window of as many slides over
each text. Windows and templates get HASHES minima; two that agree in one band of ROWS minima are
a candidate. A window with four fifths of the template's shingles has similarity 0.8 / 1.2 and is
found with probability ``1 - (1 - 0.67 ** 2) ** 16 > 0.9999``. A candidate counts if the window, an
eighth wider at both ends, contains at least 80 % of the template's shingles exactly.

A text with fewer shingles than a template is one window, decided without bands. A template of fewer
than five words is looked for as that many words in a row.

Null and empty texts hold no license. Repeated rows give the same result each. Without templates
or documents there are no rows. A text's best containment is kept for each template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import append, documents, fresh, query

SHINGLE = 5
HASHES, ROWS = 32, 2
CONTAINMENT = 0.8

#: Notices as licensors word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's begin."""
    at = W.runs(first, SHINGLE)
    counts = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    return W.shingle_hashes(hashes, at, SHINGLE), np.concatenate([[0], np.cumsum(counts)])


_FACTORS = (W.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).tolist()


def _minima(values: np.ndarray, size: int, table: list[np.ndarray]) -> np.ndarray:
    """Least of each ``size`` consecutive values, from minima over powers of two."""
    level = size.bit_length() - 1
    return np.minimum(table[level][: len(values) - size + 1], table[level][size - (1 << level) :][: len(values) - size + 1])


class Templates:
    """Shingle sets of templates by their size, and the band keys of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sets = []
        self.short: list[tuple[int, int]] = []
        by_size: dict[int, list[int]] = {}
        for i, text in enumerate(templates.values()):
            w = next(W.chunks(pa.array([text], pa.large_string()), True))[2]
            h = w.hashes()
            value = _shingles(h, w.first)[0] if len(h) >= SHINGLE else W.shingle_hashes(h, np.array([0]), len(h))
            self.sets.append(np.unique(value))
            if len(h) >= SHINGLE:
                by_size.setdefault(len(value), []).append(i)
            elif len(h):
                self.short.append((i, len(h)))
        self.sizes = sorted(by_size.items())
        self.bands = {
            i: [np.stack([((s * np.uint64(f)) >> np.uint64(32)) for f in _FACTORS]).min(axis=1)][0]
            for i, s in enumerate(self.sets)
        }

    def windows(self, values: np.ndarray, first: np.ndarray):
        """(template, text, first shingle, end) of windows that share a band with a template."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        depth = max((size for size, _ in self.sizes), default=1).bit_length()
        votes: dict[int, list[np.ndarray]] = {i: [] for i in range(len(self.names))}
        last: dict[int, np.ndarray] = {}
        for k, factor in enumerate(_FACTORS):
            table = [((values * np.uint64(factor)) >> np.uint64(32)).astype(np.uint32)]
            for level in range(1, depth):
                half, before = 1 << (level - 1), table[-1]
                table.append(np.minimum(before[:-half], before[half:]) if len(before) > half else before[:0])
            for size, members in self.sizes:
                if len(values) < size:
                    continue
                low = _minima(values, size, table)
                for i in members:
                    same = low == self.bands[i][k]
                    if k % ROWS == 0:
                        last[i] = same
                    else:
                        last[i] &= same
                    if k % ROWS == ROWS - 1:
                        votes[i].append(np.flatnonzero(last[i]))
        counts = np.diff(first)
        for size, members in self.sizes:
            for i in members:
                few = (counts < size) & (counts >= CONTAINMENT * len(self.sets[i]))
                for t in np.flatnonzero(few).tolist():
                    yield i, t, int(first[t]), int(first[t + 1])
        for size, members in self.sizes:
            step = max(1, size // 8)
            for i in members:
                at = np.unique(np.concatenate(votes[i])) if votes[i] else np.zeros(0, np.int64)
                at = at[owner[at] == owner[at + size - 1]] if len(at) else at
                for x in at.tolist():
                    t = int(owner[x])
                    yield i, t, max(x - step, int(first[t])), min(x + size + step, int(first[t + 1]))


def _scan(templates: dict[str, str]):
    made: list[Templates] = []

    def work(texts: pa.Array) -> list:
        if not made:
            made.append(Templates(templates))
        t = made[0]
        names, shares = [], []
        for _, _, w in W.chunks(texts, True):
            best: list[dict[int, float]] = [{} for _ in range(w.texts)]
            h = w.hashes()
            values, first = _shingles(h, w.first)
            for i, k in t.short:
                at = W.runs(w.first, k)
                for text in np.unique(w.text_of[at[W.shingle_hashes(h, at, k) == t.sets[i][0]]]).tolist():
                    best[text][i] = 1.0
            for i, text, a, b in t.windows(values, first) if len(values) else ():
                share = np.isin(t.sets[i], values[a:b]).mean()
                if share >= CONTAINMENT and share > best[text].get(i, 0):
                    best[text][i] = float(share)
            for found in best:
                order = sorted(found)
                names.append([t.names[i] for i in order])
                shares.append([found[i] for i in order])
        return [names, shares]

    return work


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_column: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the names of the licenses each text holds and their containments."""
    names = [fresh(docs, x) for x in ("license_names", "license_shares")]
    added = f"`{names[0]}` array<string>, `{names[1]}` array<double>"
    return append(docs, text_column, added, _scan(TEMPLATES if templates is None else templates)), names


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, names = scan(documents(spark, sf_dir).select("doc_id", "text"))
    rows = found.select("doc_id", F.explode(F.arrays_zip(*names)).alias("m"))
    return rows.select("doc_id", F.col(f"m.{names[0]}").alias("license"), F.col(f"m.{names[1]}").alias("containment"))
