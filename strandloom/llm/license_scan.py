"""License scan: winnowed fingerprints find candidate templates, banded alignment measures them.

Templates are cut into words; of each window of `window` consecutive k-grams the least hash is a fingerprint, kept in an
inverted index of (template, place). Texts are winnowed alike, so a shared run of window + k - 1 words shares a fingerprint.
Hits that lie on near diagonals are aligned word by word within a band, and the matched share of the template and the span are reported.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts_of

_WORD = re.compile(r"[^\W_]+")
#: What parts words, but not by ASCII alone.
_PARTS = re.compile(r"[^\x00-\x7f\w]")
#: Public licence notices, as they are printed in files and texts.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
RESULT = "doc_id long, license string, coverage double, matched int, start long, end long"


@dataclass(frozen=True)
class Settings:
    """k: words of a k-gram; window: k-grams of which one is a fingerprint; band: how far, in words, the text may shift against
    the template, beside a tenth of its length; at most a quarter of it; least: share of the template's words that must match."""

    k: int = 2
    window: int = 3
    band: int = 4
    least: float = 0.8


def _places(text: str) -> list[tuple[int, int]]:
    lower = text.lower()
    return [m.span() for m in _WORD.finditer(lower if len(lower) == len(text) else text)]


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Index:
    templates: dict[str, str]
    settings: Settings
    number: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        s = self.settings
        self.words = {name: [self.number.setdefault(w.encode(), len(self.number) + 1) for w in _words(t)] for name, t in self.templates.items()}
        self.counts = {name: np.bincount(ids, minlength=len(self.number) + 1) for name, ids in self.words.items()}
        self.of: dict[int, list[tuple[str, int]]] = {}
        self.any = set()
        for name, ids in self.words.items():
            grams = self.grams(np.array(ids, np.int64))
            self.any.update(grams.tolist())
            for at in self.winnowed(grams):
                self.of.setdefault(int(grams[at]), []).append((name, at))
        self.sorted = np.array(sorted(self.any), np.uint64)
        assert s.k > 0 and s.window > 0

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each k-gram."""
        n = len(ids) - self.settings.k + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(self.settings.k if n > 0 else 0):
            out = (out + ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

    def winnowed(self, grams: np.ndarray) -> list[int]:
        """The places of the least hash of each window, the right-most of equal ones; all of a text shorter than a window."""
        if len(grams) <= self.settings.window:
            return list(range(len(grams)))
        part = np.lib.stride_tricks.sliding_window_view(grams, self.settings.window)[:, ::-1]
        return np.unique(np.arange(len(part)) + self.settings.window - 1 - part.argmin(1)).tolist()

    def near(self, texts: list[str | None]) -> list[bool]:
        """Which texts hold any k-gram of any template; the others are done with."""
        plain = lambda t: re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", t.lower().encode()).split()
        words = [[t[a:b].lower().encode() for a, b in _places(t)] if _PARTS.search(t) else plain(t) for t in (t or "" for t in texts)]
        get, out = self.number.get, []
        for own in words:
            ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
            known = np.flatnonzero(ids)
            out.append(len(known) >= self.settings.k and bool(np.isin(self.grams(ids), self.sorted).any()))
        return out

    def matches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end); of overlapping findings the one with most matched words stays."""
        places = _places(text)
        ids = np.array([self.number.get(text[a:b].lower().encode(), 0) for a, b in places], np.int64)
        grams = self.grams(ids)
        hits: dict[str, set[tuple[int, int]]] = {}
        for at in self.winnowed(grams):
            for name, place in self.of.get(int(grams[at]), ()):
                hits.setdefault(name, set()).add((at - place, at))
        found = []
        for name, own in hits.items():
            size = len(self.words[name])
            band = min(self.settings.band, size // 4) + size // 10
            done = None
            for diagonal, _ in sorted(own):
                if done is not None and diagonal <= done:
                    continue
                done = diagonal + 2 * band  # up to there, a hit's own band lies within the one that is aligned
                if (one := self.aligned(ids, name, diagonal + band, 2 * band)) and one[0] >= self.settings.least * size:
                    found.append((one[0], name, one[0] / size, places[one[1]][0], places[one[2]][1]))
        out: list = []
        for matched, name, coverage, a, b in sorted(found, key=lambda x: (-x[0], x[3], x[1])):
            if not any(a < e and s < b for _, _, _, s, e in out):
                out.append((name, coverage, matched, a, b))
        return sorted(out, key=lambda x: x[3])

    def aligned(self, ids: np.ndarray, name: str, diagonal: int, band: int) -> tuple[int, int, int] | None:
        """Banded global alignment of a template along a diagonal: matched words, and the first and last matched word of the text; None where too few can match."""
        own = self.words[name]
        for d in range(max(0, diagonal - band), diagonal + band + 1):  # no other alignment matches more than a whole one
            if d < len(ids) and ids[d] == own[0] and ids[d : d + len(own)].tolist() == own:
                return len(own), d, d + len(own) - 1
        low = max(0, diagonal - band)
        part = ids[low : max(0, diagonal + len(own) + band)]
        # each word matches at most as often as both sides hold it
        if np.minimum(np.bincount(part, minlength=len(self.number) + 1), self.counts[name]).sum() < self.settings.least * len(own):
            return None
        part = part.tolist()
        shift = diagonal - low
        # best[j]: (matched words, minus the gaps, first, last) after template word i and text word j, inside the band only
        # where the text begins or ends inside the template, the band stays at its edge and the rest of the template counts as gaps
        before = {j: (0, 0, -1, -1) for j in range(0, max(0, shift + band) + 1)}
        for i, w in enumerate(own):
            row: dict[int, tuple] = {}
            for j in range(min(len(part), max(0, i + shift - band)), min(len(part), max(0, i + 1 + shift + band)) + 1):
                options = []
                if j in before:
                    m, g, a, b = before[j]
                    options.append((m, g - 1, a, b))
                if j - 1 in row:
                    m, g, a, b = row[j - 1]
                    options.append((m, g - 1, a, b))
                if j > 0 and j - 1 in before:
                    m, g, a, b = before[j - 1]
                    same = part[j - 1] == w
                    options.append((m + 1, g, a if a >= 0 else j - 1, j - 1) if same else (m, g - 2, a, b))
                if options:
                    row[j] = max(options)
            before = row
        m, _, a, b = max(before.values())
        return (m, low + a, low + b) if m else None


@functools.lru_cache(maxsize=4)
def _index(templates: tuple, settings: Settings) -> Index:
    return Index(dict(templates), settings)


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple, settings: Settings) -> Iterator[pa.RecordBatch]:
    index = _index(templates, settings)
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        keys, rows = batch.column(0).to_pylist(), []
        for at, texts in texts_of(batch):
            for k, near in enumerate(index.near(texts)):
                rows += [(keys[at + k], *m) for m in (index.matches(texts[k]) if near else ())]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per finding: doc_id, license, coverage (matched words by the template's), matched, start, end (code points, end exclusive).

    Null and empty texts have none; a null id stays null; repeated rows are scanned each; an empty table gives an empty
    result; other columns are ignored. No shuffle; the index is as large as the templates.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    named = tuple((templates if templates is not None else TEMPLATES).items())
    return arrow_map(rows, functools.partial(_scan, templates=named, settings=settings), RESULT)
