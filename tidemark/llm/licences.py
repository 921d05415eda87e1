"""Licence scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into words; hashes of their runs of ``GRAM`` words are winnowed (of each window of
``WINDOW`` neighbouring hashes the smallest stays), and an inverted index leads from a fingerprint to
the templates and places that have it. Every run of a document is looked up. Hits of one template on
neighbouring diagonals make a candidate, which a banded local alignment of words turns into matched
coverage and a span. The index is as large as the templates, not as the documents.

No copy with few enough changes is missed. A copy of a template of n words with e words replaced, left
out or added has a run of at least (n - e) / (e + 1) template words, rounded up, that is intact. With
e <= n / 5, the most that COVERAGE leaves, that is 4 words or more from n = 16 on, and 2 or more for shorter
templates. Any run of GRAM + WINDOW - 1 = 4 words holds a fingerprint; templates of fewer than ``SHORT``
words keep all their runs of two words. Before a candidate
is aligned, the words in reach of the band are counted: an alignment can't match more template words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

GRAM = 3
WINDOW = 2
#: Templates of fewer words are indexed by every run of two words.
SHORT = 16
SHORT_GRAM = 2
#: Diagonals on either side of a candidate's that an alignment may reach.
BAND = 12
#: Share of a template's words that must match.
COVERAGE = 0.8

# Usual licence notices.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit-short": "Released under the MIT License.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id long, licence string, coverage double, matched_words long, start long, end long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_hashes(ids: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of ``gram`` word numbers."""
    n = len(ids) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def winnow(h: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the smallest hash of each window, the last of equals."""
    if not len(h):
        return []
    w = min(window, len(h))
    return sorted({i + w - 1 - int(np.argmin(h[i : i + w][::-1])) for i in range(len(h) - w + 1)})


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[list[int]]
    vocabulary: dict[str, int]
    #: By length of run: fingerprint to (template, place).
    postings: dict[int, dict[int, list[tuple[int, int]]]]
    keys: dict[int, np.ndarray]

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        """Templates with fewer than SHORT_GRAM words can't be found and raise ValueError."""
        names, words, vocabulary = sorted(templates), [], {}
        postings: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM: defaultdict(list), SHORT_GRAM: defaultdict(list)}
        for t, name in enumerate(names):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(templates[name])]
            if len(ids) < SHORT_GRAM:
                raise ValueError(f"template {name} has fewer than {SHORT_GRAM} words")
            words.append(ids)
            gram, window = (SHORT_GRAM, 1) if len(ids) < SHORT else (GRAM, WINDOW)
            h = gram_hashes(np.array(ids), gram)
            for i in winnow(h, window):
                postings[gram][int(h[i])].append((t, i))
        return Index(names, words, vocabulary, {g: dict(p) for g, p in postings.items()}, {g: np.array(sorted(p), np.uint64) for g, p in postings.items()})


def align(template: list[int], text: list[int], offset: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last) of the best local alignment near a diagonal.

    Template word i may meet text word i + offset + e for e within the band. A match scores 2, a
    mismatch or gap -1. first and last are places in the text (last included); no match: (0, 0, -1).
    """
    width = 2 * band + 1
    none = (0, 0, 0, -1)  # score, matched, first, last
    best, row = none, [none] * (width + 1)
    for i, w in enumerate(template):
        new = [none] * (width + 1)
        for e in range(width):
            j = i + offset + e - band
            if not 0 <= j < len(text):
                continue
            s, m, a, z = row[e]  # diagonal: the same e one word earlier
            if text[j] == w:
                got = (s + 2, m + 1, a if m else j, j)
            else:
                got = (s - 1, m, a, z)
            for s, m, a, z in ((row[e + 1]), (new[e - 1] if e else none)):  # a word of either side skipped
                if s - 1 > got[0]:
                    got = (s - 1, m, a, z)
            new[e] = got if got[0] > 0 else none
            if new[e][0] > best[0]:
                best = new[e]
        row = new
    return best[1], best[2], best[3]


def scan(text: str, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, float, int, int, int]]:
    """(licence, coverage, matched words, start, end) of each match; offsets are characters."""
    get = index.vocabulary.get
    ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    diagonals: dict[int, set[int]] = defaultdict(set)
    for gram, keys in index.keys.items():
        places = np.flatnonzero(unknown[gram:] == unknown[:-gram])
        if not len(places):
            continue
        h = gram_hashes(ids, gram)[places]
        hit = np.isin(h, keys)
        for p, key in zip(places[hit].tolist(), h[hit].tolist(), strict=True):
            for t, i in index.postings[gram][key]:
                diagonals[t].add(p - i)
    if not diagonals:
        return []
    listed = ids.tolist()
    found: list[tuple[str, float, int, int, int]] = []
    for t, ds in sorted(diagonals.items()):
        kept: list[tuple[int, int, int]] = []
        size = len(index.words[t])
        own = np.concatenate([[0], np.cumsum(np.isin(ids, index.words[t]))])  # template words so far
        free, last = listed.copy(), None
        for d in sorted(ds):
            if last is not None and d - last <= band // 2:
                continue  # the alignment at ``last`` reaches this diagonal
            if own[min(len(ids), max(0, d + size + band))] - own[min(len(ids), max(0, d - band))] < coverage * size:
                continue  # too few template words in reach
            last = d
            while True:  # copies close to each other lie in one band: each match frees the next
                matched, a, z = align(index.words[t], free, d, band)
                if matched < coverage * size:
                    break
                kept.append((matched, a, z))
                free[a : z + 1] = [-2] * (z + 1 - a)
        found += [(index.names[t], m / size, m, a, z) for m, a, z in sorted(kept, key=lambda k: k[1])]
    if not found:
        return []
    lowered = text.lower()
    spans = [m.span() for m in WORD.finditer(text if len(lowered) == len(text) else lowered)]
    return [(name, c, m, spans[a][0], spans[z][1]) for name, c, m, a, z in found]


def licence_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each match: doc_id, licence, coverage, matched_words, start, end.

    Whole texts are scanned. A null or empty text has no matches; a null doc_id stays null; repeated
    rows give their matches each; an empty table gives an empty one; other columns are not read.
    """
    index = Index.of(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *m) for d, x in zip(column(b, "doc_id").to_pylist(), column(b, "text"), strict=True) for m in scan(x.as_py() or "", index, coverage)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "licence", "coverage", "matched_words", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
