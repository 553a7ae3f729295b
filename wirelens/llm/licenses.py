"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are words (letters and digits, lower case). Of the
hashes of all runs of ``RUN`` words, winnowing keeps the smallest in every
window of ``WINDOW``, so whatever shares RUN + WINDOW - 1 words shares a kept
fingerprint. The templates' fingerprints are an inverted index; a document's
fingerprint found there names a template and an alignment, and a local
alignment in a band around it gives the words of the template that are there,
and where. An occurrence is reported when it covers ``COVERAGE`` of its template.

Documents are read once and nothing is shuffled. The index is shared with all
tasks in passes of templates of at most ``PASS_BYTES``, so any number of
templates can be scanned.

Defined results: NULL, empty and unlicensed texts give no rows; every
occurrence in a text is a row, as are repeated documents; NULL ids stay NULL;
templates that are NULL or shorter than RUN words never match; empty tables
work; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import columns

RUN = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.8
PASS_BYTES = 4 << 20
WORD = re.compile(r"[^\W_]+")

#: Published notices and header texts of common licenses.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
)

RESULT = (
    "license string, template string, matched_words long, template_words long, coverage double, "
    "start_word long, end_word long, start_char long, end_char long"
)


def winnow(hashes):
    """Places of the kept hashes: the last smallest one of every window."""
    import numpy as np

    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(WINDOW, n)
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)
    last = w - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(np.arange(n - w + 1) + last)


def run_hashes(words: list[str]):
    import numpy as np
    import xxhash

    n = len(words)
    if n < RUN:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, n)
    out = np.zeros(n - RUN + 1, np.uint64)
    for j in range(RUN):
        out ^= h[j : n - RUN + 1 + j]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def align(template: list[str], words: list[str], diagonal: int) -> tuple[int, int, int]:
    """Best local alignment within BAND of a diagonal (document place minus template place): matched words, start and end in the document."""
    best = (0, 0, 0, 0)
    # score, matched, start; column d of row i is the document place i + diagonal + d - BAND
    before = [(0, 0, 0)] * (2 * BAND + 1)
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for d in range(2 * BAND + 1):
            j = i + diagonal + d - BAND
            if not 0 <= j < len(words):
                row.append((0, 0, 0))
                continue
            score, matched, start = before[d]
            if words[j] == word:
                cell = (score + 2, matched + 1, start if score > 0 else j)
            else:
                cell = (score - 1, matched, start)
            if d < 2 * BAND and before[d + 1][0] - 1 > cell[0]:
                cell = (before[d + 1][0] - 1, *before[d + 1][1:])
            if d > 0 and row[d - 1][0] - 1 > cell[0]:
                cell = (row[d - 1][0] - 1, *row[d - 1][1:])
            if cell[0] <= 0:
                cell = (0, 0, 0)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
        before = row
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]]):
        self.templates = [(name, kind, WORD.findall(text.lower())) for name, kind, text in templates if text]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, _, words) in enumerate(self.templates):
            hashes = run_hashes(words)
            for place in winnow(hashes).tolist():
                self.index.setdefault(int(hashes[place]), []).append((t, place))
        import numpy as np

        self.known = np.array(sorted(self.index), np.uint64)

    def scan(self, text: str | None) -> list[tuple]:
        import numpy as np

        # lower-casing can change a text's length, so places are counted in words and found again in the text
        words = [w.lower() for w in WORD.findall(text or "")]
        hashes = run_hashes(words)
        kept = winnow(hashes)
        kept = kept[np.isin(hashes[kept], self.known)] if len(kept) else kept
        hits: dict[int, list[tuple[int, int]]] = {}
        for place in kept.tolist():
            for t, at in self.index[int(hashes[place])]:
                hits.setdefault(t, []).append((place, place - at))
        found = []
        for t, places in hits.items():
            name, kind, template = self.templates[t]
            done = 0
            for place, diagonal in places:
                if place < done:
                    continue
                matched, start, end = align(template, words, diagonal)
                if matched >= COVERAGE * len(template):
                    found.append((name, kind, matched, len(template), matched / len(template), start, end))
                    done = end
        if not found:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        return [(*f, spans[f[5]][0], spans[f[6] - 1][1]) for f in sorted(found, key=lambda f: (f[5], f[6], f[0], f[1]))]


def _passes(templates: list[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    passes: list[list] = [[]]
    size = 0
    for t in templates:
        length = len((t[2] or "").encode())
        if size + length > PASS_BYTES and passes[-1]:
            passes.append([])
            size = 0
        passes[-1].append(t)
        size += length
    return passes


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, template, matched_words, template_words, coverage and the span of every license text in ``docs``.

    ``templates`` are (license, template, text). Words and characters are
    counted from 0, ends are exclusive.
    """
    rows = columns(docs, "doc_id", "text")
    result = T.StructType.fromDDL(RESULT)
    schema = T.StructType([rows.schema["doc_id"], *result.fields])

    def one(part: list[tuple[str, str, str]]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(part)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            for batch in batches:
                found, at = [], []
                for n, text in enumerate(batch.column(1)):
                    for f in scanner.scan(text.as_py()):
                        found.append(f)
                        at.append(n)
                values = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *values], schema.fieldNames())

        return rows.mapInArrow(work, schema)

    out = None
    for part in _passes(list(templates)):
        out = one(part) if out is None else out.unionByName(one(part))
    return out.withColumn("coverage", F.round("coverage", 6))
