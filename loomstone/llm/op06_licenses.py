"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

A template's words are hashed in overlapping runs of GRAM; of each WINDOW consecutive hashes the least is kept
(winnowing), and an inverted index holds the kept hashes with templates and positions. Templates shorter than GRAM
words are one run. A document's runs are looked up in the index; each hit votes for a template and a diagonal
(document position less template position). Around a diagonal with a hit, the template is aligned with the document
in a band of BAND words to either side; matched words over the template's words are the coverage, and the first and
last matched words give the span in code points. Reported is each place whose coverage reaches LEAST; of places of one
template that overlap, the one with the higher coverage, then the earlier one; of templates whose places overlap, the
one that matches more words. A place must also hold, word by word, what TELLING says of its template: the name and version
that tell it from others. Templates are whole license texts (folder `licenses`), headers, openings and notices.

Words are runs of letter and digit bytes, A-Z folded, so punctuation and line breaks do not count.

Defined cases: null and empty texts have no match; a license that stands k times in a text gives k rows; long texts
are read whole; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table
from .textnum import U64, buffers, chunks, mix, words

GRAM, WINDOW, BAND, LEAST = 3, 2, 6, 0.8
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

# Notices by which licenses are usually named or granted.
TEMPLATES = {
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT-notice": "Released under the MIT License",
    "MIT-notice-licensed": "Licensed under the MIT License",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-notice": "licensed under the GNU Lesser General Public License",
    "AGPL-notice": "licensed under the GNU Affero General Public License",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain",
    "All-rights-reserved": "All rights reserved",
}

# What must stand word by word in a place of the template.
TELLING = {
    "MIT-notice": ("MIT License",),
    "MIT-notice-licensed": ("MIT License",),
    "Apache-2.0-header": ("Apache License, Version 2.0",),
    "Apache-2.0-notice": ("Apache License, Version 2.0",),
    "GPL-3.0-notice": ("GNU General Public License, version 3",),
    "GPL-2.0-notice": ("GNU General Public License, version 2",),
    "LGPL-notice": ("GNU Lesser General Public License",),
    "AGPL-notice": ("GNU Affero General Public License",),
    "MPL-2.0-header": ("Mozilla Public License, v. 2.0",),
}

_HEADER = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version"
for _id, _name, _versions in (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("LGPL", "Library General Public License", ("2",)), ("AGPL", "Affero General Public License", ("3",))):
    for _v in _versions:
        _key = f"{_id}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[f"{_key}-header"] = _HEADER.format("This program" if _id != "LGPL" else "This library", _name, _v)
        TELLING[f"{_key}-header"] = (f"GNU {_name}", f"version {_v} of")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _id, _name in _CC.items():
    for _v, _kind in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_id}-{_v}"] = f"This work is licensed under a Creative Commons {_name} {_v} {_kind} License"
        TELLING[f"CC-{_id}-{_v}"] = (f"Creative Commons {_name} {_v}",)
        TEMPLATES[f"CC-{_id}-{_v}-notice"] = f"Licensed under CC {_id} {_v}"
        TELLING[f"CC-{_id}-{_v}-notice"] = (f"CC {_id} {_v}",)
TEMPLATES |= {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), U64)
    for j in range(k):
        out = out * U64(0xFF51AFD7ED558CCD) + h[j : j + len(out)]
    return mix(out + U64(k))


def apart(places: list[tuple]) -> list[tuple]:
    """Of places (..., first, last), in turn, those that overlap none before."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for x in places:
        first, last = x[-2:]
        k = bisect_left(starts, first)
        if (k == 0 or ends[k - 1] < first) and (k == len(starts) or starts[k] > last):
            starts.insert(k, first)
            ends.insert(k, last)
            out.append(x)
    return out


class Templates:
    """Hashed templates and their inverted index."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.words = list(texts), []
        self.telling = [[self._hashed(x) for x in TELLING.get(t, ())] for t in texts]
        index: list[tuple[int, int, int, int]] = []  # run length, hash, template, position
        for t, text in enumerate(texts.values()):
            h = self._hashed(text)
            self.words.append(h)
            k = min(GRAM, len(h))
            r = _runs(h, k)
            for i in range(max(1, len(r) - WINDOW + 1)):
                j = i + int(np.argmin(r[i : i + WINDOW]))
                index.append((k, int(r[j]), t, j))
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, h, t, j in sorted(set(index)):
            self.index.setdefault(k, {}).setdefault(h, []).append((t, j))
        self.sorted = {k: np.array(sorted(v), U64) for k, v in self.index.items()}

    @staticmethod
    def _hashed(text: str) -> np.ndarray:
        return words(*buffers(pa.array([text])), inner=_WORD)[0]

    def told(self, doc: np.ndarray, t: int) -> bool:
        """Whether each telling phrase of template t stands in doc."""
        return all(len(x) <= len(doc) and (np.lib.stride_tricks.sliding_window_view(doc, len(x)) == x).all(1).any() for x in self.telling[t])

    def within_reach(self, doc: np.ndarray, t: int, diagonal: int, least: float) -> bool:
        """Whether enough words of the template stand in the band at all: no alignment matches more."""
        a = self.words[t]
        need = least * len(a)
        if min(len(doc), diagonal + len(a) + BAND) - max(0, diagonal - BAND) < need:
            return False
        some = np.zeros(len(a), bool)
        for d in range(diagonal - BAND, diagonal + BAND + 1):
            i, j = max(0, -d), min(len(a), len(doc) - d)
            if i < j:
                some[i:j] |= a[i:j] == doc[i + d : j + d]
        return np.count_nonzero(some) >= need

    def hits(self, h: np.ndarray, at: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """By row, the (template, diagonal) of its index hits."""
        out: dict[int, set[tuple[int, int]]] = {}
        for k, known in self.sorted.items():
            r = _runs(h, k)
            if not len(r):
                continue
            place = np.minimum(np.searchsorted(known, r), len(known) - 1)
            found = np.flatnonzero(known[place] == r)
            rows = np.searchsorted(at, found, "right") - 1
            for i, row in zip(found.tolist(), rows.tolist()):
                if i + k <= at[row + 1]:
                    out.setdefault(row, set()).update((t, i - int(at[row]) - j) for t, j in self.index[k][int(r[i])])
        return out

    def align(self, doc: np.ndarray, t: int, diagonal: int) -> tuple[int, int, int] | None:
        """Matched words and the first and last matched place, of the best common subsequence in the band."""
        a = self.words[t]
        low = max(0, diagonal - BAND)
        b = doc[low : max(0, diagonal + len(a) + BAND)]
        n, m = len(a), len(b)
        if not m:
            return None
        a, b = a.tolist(), b.tolist()
        best, end = [(0, 0, -1, -1)] * (m + 1), 0  # matches, -span, first, last; right of end as at end
        for i in range(n):
            mid = i + diagonal - low
            left, right = max(1, mid - BAND + 1), min(m, mid + BAND + 1)
            if left > right:
                continue
            for j in range(end + 1, right + 1):
                best[j] = best[end]
            end = max(end, right)
            corner = before = best[left - 1]
            for j in range(left, right + 1):
                above = best[j]
                top = max(above, before)
                if a[i] == b[j - 1]:
                    c, _, first, _ = corner
                    first = j - 1 if first < 0 else first
                    top = max(top, (c + 1, first - j, first, j - 1))
                best[j] = before = top
                corner = above
        c, _, first, last = best[end]
        return (c, low + first, low + last) if c else None

    def matches(self, doc: np.ndarray, hits: set[tuple[int, int]], least: float) -> list[tuple[int, int, int, int]]:
        """(template, matched, first word, last word) of the places that stay."""
        found = []
        for t in sorted({t for t, _ in hits}):
            places = []
            last = None
            for d in sorted(d for x, d in hits if x == t):
                if last is not None and d - last <= BAND // 2:
                    continue  # inside the band just aligned
                if not self.within_reach(doc, t, d, least):
                    continue
                last = d
                x = self.align(doc, t, d)
                if x and x[0] >= least * len(self.words[t]) and self.told(doc[x[1] : x[2] + 1], t):
                    places.append(x)
            found += [(t, *x) for x in apart(sorted(places, key=lambda x: (-x[0], x[1], x[2])))]
        return sorted(apart(sorted(found, key=lambda x: (-x[1], x[2], x[0]))), key=lambda x: (x[2], x[0]))


OUT = "doc_id long, license string, coverage double, matched long, start long, end long"


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row for each license found in docs(doc_id, text); start and end are code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for b in batches:
            data, offsets = buffers(b.column(1))
            ids = b.column(0).to_pylist()
            rows = []
            for i, j in chunks(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, start, end, at = words(part, off, inner=_WORD)
                for row, hits in sorted(known.hits(h, at).items()):
                    s0 = int(at[row])
                    for t, c, s, e in known.matches(h[s0 : int(at[row + 1])], hits, least):
                        a = len(part[off[row] : start[s0 + s]].tobytes().decode())
                        z = a + len(part[start[s0 + s] : end[s0 + e]].tobytes().decode())
                        rows.append((ids[i + row], known.names[t], c / len(known.words[t]), c, a, z))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "coverage", "matched", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read_table(spark, sf_dir, "documents"))
