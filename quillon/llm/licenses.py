"""License scan: normalised text against license templates by the Dice coefficient over word bigrams.

Candidates are all windows of words over the whole text whose size the threshold allows, so that a notice is found inside
a longer line or paragraph and a license wrapped into lines is found whole. Templates are short notices, headers of each
version and whole license texts (license_texts). They are indexed by bigram; a template is compared only if the text
shares enough bigrams, and only from and to words that it shares. Numbers in a template's text count as words, and a
window must hold the numbers of a notice or header, so versions tell licenses apart.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import repeat
from math import ceil, floor
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, prepare

THRESHOLD = 0.8

# Short notices that name a license, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Headers and names of every version, made from one wording each.
_GNU = [
    ("General", "GPL", ("1", "2", "3")), ("Library General", "LGPL", ("2",)), ("Lesser General", "LGPL", ("2.1", "3")), ("Affero General", "AGPL", ("3",)),
]
_CC = [("Attribution", "BY"), ("Attribution-ShareAlike", "BY-SA"), ("Attribution-NonCommercial", "BY-NC"), ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("Attribution-NoDerivs", "BY-ND"), ("Attribution-NoDerivatives", "BY-ND"), ("Attribution-NonCommercial-NoDerivs", "BY-NC-ND"), ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND")]
for _name, _short, _versions in _GNU:
    for _v in _versions:
        _id, _terms = f"{_short}-{_v if '.' in _v else _v + '.0'}", f"you can redistribute it and/or modify it under the terms of the GNU {_name} Public License"
        TEMPLATES += [(_id, f"This {what} is free software: {_terms} {rest}.") for what in ("program", "library") for rest in (
            f"as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version",
            f"as published by the Free Software Foundation, version {_v} of the License",
            f"version {_v} as published by the Free Software Foundation",
        )]
        TEMPLATES.append((_id, f"This work is licensed under the GNU {_name} Public License, version {_v}."))
for _name, _short in _CC:
    for _v, _where in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES += [(f"CC-{_short}-{_v}", f"Licensed under CC {_short} {_v}."), (f"CC-{_short}-{_v}", f"This work is licensed under a Creative Commons {_name} {_v} {_where} License.")]
TEMPLATES = list(dict.fromkeys(TEMPLATES))

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Templates of fewer bigrams are notices and headers, whose numbers a window must hold.
SHORT = 100


@lru_cache
def whole_texts() -> list[tuple[str, str]]:
    """Whole licenses by SPDX identifier."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def bigrams(text: str) -> Counter:
    """Multiset of pairs of neighbouring words, lower-cased; a single word is a pair with nothing."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, [*words[1:], ""], strict=True)) if len(words) == 1 else Counter(zip(words, words[1:], strict=False))


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.ids = [name for name, _ in templates]
        self.grams = [bigrams(t) for _, t in templates]
        self.sizes = [sum(g.values()) for g in self.grams]
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for t, grams in enumerate(self.grams):
            for g, n in grams.items():
                self.index.setdefault(g, []).append((t, n))
        self.word = {w: k for k, w in enumerate(sorted({w for g in self.grams for pair in g for w in pair if w}))}
        coded = sorted((self.word[a] * len(self.word) + self.word[b], t, m) for (a, b), x in self.index.items() if b for t, m in x)
        self.codes, first = np.unique(np.array([c for c, _, _ in coded], np.int64), return_index=True)
        self.first = np.append(first, len(coded))
        self.owner, self.often = (np.array([x[k] for x in coded], np.int64) for k in (1, 2))
        size = np.array(self.sizes, np.int64)
        # Dice >= t needs that share of the template's bigrams, and no more than so many in the window
        self.need = np.array([max(1, ceil(n * threshold / (2 - threshold) - 1e-9)) for n in self.sizes], np.int64)
        self.room = [floor(n * (2 - threshold) / threshold + 1e-9) for n in size.tolist()]
        self.numbers = [sorted({self.word[w] for pair in g for w in pair if w[:1].isdigit()}) if n < SHORT else [] for g, n in zip(self.grams, self.sizes, strict=True)]
        self.alone = {self.word[a]: t for t, g in reversed(list(enumerate(self.grams))) for a, b in g if not b}
        low, high = min(self.sizes, default=0), max(self.sizes, default=0)
        # Dice >= t needs sizes within a factor of (2 - t) / t
        self.least, self.most = low * threshold / (2 - threshold), high * (2 - threshold) / threshold

    def best(self, text: str) -> tuple[str, float] | None:
        """The template of greatest Dice with all of the text at or above the threshold, ties to the first."""
        # a word has a character and a separator at least, so a longer text can't be too small; the words decide the rest
        if len(text) < self.least * 2 or not self.ids:
            return None
        grams = bigrams(text)
        size = sum(grams.values())
        if not self.least <= size <= self.most:
            return None
        shared: dict[int, int] = {}
        for g, n in grams.items():
            for t, m in self.index.get(g, ()):
                shared[t] = shared.get(t, 0) + min(n, m)
        found = [(2 * k / (size + self.sizes[t]), -t) for t, k in shared.items() if 2 * k >= self.threshold * (size + self.sizes[t])]
        if not found:
            return None
        dice, t = max(found)
        return self.ids[-t], dice

    def windows(self, ids: np.ndarray, t: int, at: np.ndarray, gram: np.ndarray, often: np.ndarray):
        """From each word that begins a bigram of template t the window of greatest Dice, if it reaches the threshold:
        (matched less unmatched bigrams, Dice, first word, last word). at: places of t's bigrams in the text; often: how
        many of each t has."""
        size, need, room = self.sizes[t], int(self.need[t]), self.room[t]
        # a bigram counts in a window unless as many as t has stand in the window before it
        order = np.lexsort((at, gram))
        back = np.full(len(at), -1, np.int64)
        rank = np.arange(len(at)) - often[order]
        same = (rank >= 0) & (gram[order[rank]] == gram[order])
        back[order[same]] = at[order[rank[same]]]
        stop = np.searchsorted(at, at + room)
        places = [np.flatnonzero(ids == w) for w in self.numbers[t]]
        for a in np.flatnonzero(stop - np.arange(len(at)) >= need).tolist():
            s, b = int(at[a]), int(stop[a])
            first = a
            for p in places:
                k = int(np.searchsorted(p, s))
                first = max(first, int(np.searchsorted(at, p[k] - 1)) if k < len(p) else b)
            if first >= b:
                continue
            shared = np.cumsum(back[a:b] < s)[first - a :]
            total = at[first:b] - s + 1 + size
            k = int(np.argmax(2 * shared / total))
            if 2 * shared[k] >= self.threshold * total[k]:
                yield int(3 * shared[k] - total[k]), float(2 * shared[k] / total[k]), s, int(at[first + k]) + 1

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """License, Dice, start and end (characters) of the windows that match a template. Of windows that overlap the
        one with most matched less unmatched bigrams stays, then greater Dice, then the earlier, then the first template."""
        low = text.lower()
        get = self.word.get
        words = _WORD.findall(low)
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        found: list[tuple[int, float, int, int, int]] = []
        for w, t in self.alone.items():
            found += [(1, 1.0, -k, -t, k) for k in np.flatnonzero(ids == w).tolist()]
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 and len(self.codes) else np.zeros(0, np.int64)
        if len(at):
            code = ids[at] * len(self.word) + ids[at + 1]
            gram = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[gram] == code
            at, gram = at[known], gram[known]
            some, n = np.unique(gram, return_counts=True)
            width = self.first[some + 1] - self.first[some]
            rows = np.repeat(self.first[some] - np.cumsum(width) + width, width) + np.arange(width.sum())
            shared = np.bincount(self.owner[rows], np.minimum(np.repeat(n, width), self.often[rows]), minlength=len(self.ids))
            for t in np.flatnonzero((shared >= self.need) & (np.array(self.sizes) > 0)).tolist():
                own = rows[self.owner[rows] == t]
                times = np.zeros(len(self.codes), np.int64)
                times[np.searchsorted(self.first, own, side="right") - 1] = self.often[own]
                m = times[gram]
                found += [(score, dice, -s, -t, e) for score, dice, s, e in self.windows(ids, t, at[m > 0], gram[m > 0], m[m > 0])]
        if not found:
            return []
        taken, chosen = np.zeros(len(ids), bool), []
        for _, dice, s, t, e in sorted(found, reverse=True):
            if not taken[-s : e + 1].any():
                taken[-s : e + 1] = True
                chosen.append((-s, e, self.ids[-t], dice))
        spans = [m.span() for m in _WORD.finditer(low)]
        if len(low) != len(text):  # a few characters are longer in lower case
            place = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
            spans = [(place[a], place[b - 1] + 1) for a, b in spans]
        return [(name, dice, spans[s][0], spans[e][1]) for s, e, name, dice in sorted(chosen)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or its columns) with licenses: array of license, dice, start and end over the whole text.

    Null and empty texts have none, as has an empty template list. Row by row: repeated rows and other columns pass."""
    prepare(docs.sparkSession)
    given = TEMPLATES + whole_texts() if templates is None else templates  # read here, so that workers need no files
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    made_of: list[Templates] = []

    def run(b: pa.RecordBatch):
        if not made_of:
            made_of.append(Templates(given, threshold))
        t = made_of[0]
        return [pa.array([[dict(zip(("license", "dice", "start", "end"), x, strict=True)) for x in t.scan(s or "")] for s in b.column(b.schema.names.index(text)).to_pylist()], kind)]

    extra = "licenses array<struct<license: string, dice: double, start: long, end: long>>"
    return arrow_map(docs, docs.columns if columns is None else columns, extra, run, (text,))
