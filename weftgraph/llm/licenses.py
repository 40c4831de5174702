"""License scans: MinHash bands over overlapping windows find templates, containment verifies them.

Words are lower-cased runs of letters and digits; a shingle is five words. A template of m shingles
is looked for in windows of 2S shingles at every S-th place, S being the power of two from m up: each
run of m shingles lies whole in one window. Such a window that holds a share c of the template has a
resemblance of c m / (2S + (1 - c) m) at least, so 4 / 21 for c = 0.8 at the worst S. With
``BANDS`` bands of one MinHash each the template is then found with a probability of
1 - (17 / 21) ** 48 > 0.9999. Candidates are verified over the words themselves: containment is the
share of the template's distinct shingles in a run no longer than a window, 0.8 or more being a match.
Candidate windows of a template are looked at together, and every place is told: of runs with a word
in common the one in the template's order, then the fullest, the shortest, the first.

Everything happens in the pass that reads the text; nothing is shuffled. Templates are a parameter
and go to the workers with the code. Long texts are taken in overlapping segments of bounded size.

Edge cases: null texts are empty; texts or templates under five words are one shingle of all their
words (such a template matches only texts of just those words); places of one template never share a
word; a null doc_id stays null; repeated rows report each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, CONTAINMENT, BANDS, SEGMENT, REMEMBERED = 5, 0.8, 48, 1 << 15, 100_000
_WORD = re.compile(r"[^\W_]+")

#: Notices and grants in common use: name and text.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (BANDS, 1), dtype=np.uint64) | np.uint64(1)
MATCH = "doc_id long, license string, containment double, start int, end int"


class Hashes(dict):
    """64-bit hash of a word; remembers the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingle_hashes(words: list[str], known: Hashes) -> np.ndarray:
    """A hash for each shingle; for fewer than five words one of all."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def signs(hashes: np.ndarray) -> np.ndarray:
    """(BANDS, n): the hash under each band's permutation."""
    return (hashes[None, :] ^ _SEEDS) * _SEEDS


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.known = Hashes()
        self.places: dict[str, dict[str, list[int]]] = {}  # of each shingle in the template
        self.size: dict[str, int] = {}
        by_size: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in templates.items():
            words = _WORD.findall(text.lower())
            if words:
                m = max(1, len(words) - SHINGLE + 1)
                self.places[name] = {}
                for k in range(m):
                    self.places[name].setdefault(" ".join(words[k : k + SHINGLE]), []).append(k)
                self.size[name] = 1 << (m - 1).bit_length()
                by_size.setdefault(self.size[name], []).append((name, signs(shingle_hashes(words, self.known)).min(1)))
        self.by_size = []
        for size, own in sorted(by_size.items()):
            marked = np.zeros(1 << 16, bool)
            names: dict[int, set[str]] = {}
            for name, least in own:
                marked[(least >> np.uint64(48)).astype(np.int64)] = True
                for v in least.tolist():
                    names.setdefault(v, set()).add(name)
            self.by_size.append((size, marked, names))
        self.most = max((s for s, _, _ in self.by_size), default=1)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int, str]]:
        """(first shingle, size S, template) of the windows with a band's MinHash in common.
        ``first`` has the first shingle of each text or segment in ``hashes``."""
        out: set[tuple[int, int, str]] = set()
        if not len(hashes):
            return out
        values = signs(hashes)
        each = np.diff(np.r_[first, len(hashes)])
        for size, marked, names in self.by_size:
            blocks = -(-each // size)
            place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = np.repeat(first, blocks) + place * size
            least = np.minimum.reduceat(values, start, axis=1) if size > 1 else values
            last = np.r_[place[1:] == 0, True]  # no block of the text follows: a window by itself
            least = np.where(last[None, :], least, np.minimum(least, np.c_[least[:, 1:], least[:, -1:]]))
            for band, at in zip(*np.nonzero(marked[(least >> np.uint64(48)).astype(np.int64)]), strict=True):
                for name in names.get(int(least[band, at]), ()):
                    out.add((int(start[at]), size, name))
        return out

    def spans(self, hits: list[tuple[int, str]], name: str, ordered: bool) -> list[tuple[float, int, int, int]]:
        """(-containment, length, first and last shingle) of the runs that hold the template, one at
        most for each hit, its last: back from there as long as no shingle occurs more often than in
        the template, the run fits a window and, if ``ordered``, follows the template."""
        own, longest = self.places[name], 2 * self.size[name]
        out, seen, low, last = [], Counter(), 0, -1
        for k, (place, s) in enumerate(hits):
            at = next((p for p in own[s] if p > last), own[s][0])
            if ordered and at <= last:
                low = k
                seen.clear()
            last = at
            seen[s] += 1
            while seen[s] > len(own[s]) or place - hits[low][0] >= longest:
                old = hits[low][1]
                seen[old] -= 1
                if not seen[old]:
                    del seen[old]
                low += 1
            share = len(seen) / len(own)
            if share >= CONTAINMENT:
                out.append((-share, place - hits[low][0], hits[low][0], place))
        return out

    def apart(self, hits: list[tuple[int, str]], name: str) -> list[tuple[int, int, float]]:
        """(first shingle, last shingle, containment) of places without a common word: those in the
        template's order first, then the fullest, the shortest, the first; then what lies between."""
        out: list[tuple[int, int, float]] = []
        pieces = [hits]
        while pieces:
            piece = pieces.pop()
            taken: list[tuple[int, int, float]] = []
            for share, _, a, b in sorted(self.spans(piece, name, True)) + sorted(self.spans(piece, name, False)):
                k = bisect(taken, (a, b, 2.0))
                if (not k or taken[k - 1][1] + SHINGLE <= a) and (k == len(taken) or b + SHINGLE <= taken[k][0]):
                    taken.insert(k, (a, b, -share))
            out += taken
            at = 0
            for a, b, _ in taken:
                upto, after = bisect(piece, (a - SHINGLE + 1,)), bisect(piece, (b + SHINGLE,))
                pieces += [piece[at:upto]] if at < upto else []
                at = after
            pieces += [piece[at:]] if taken and at < len(piece) else []
        return out

    def verify(self, words: list[str], found: set[tuple[int, int, str]]) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, last word) of the places that hold, apart."""
        windows: dict[str, list[int]] = {}
        for at, _, name in sorted(found):
            windows.setdefault(name, []).append(at)
        out: list[tuple[str, float, int, int]] = []
        for name, starts in windows.items():
            own, hits, done = self.places[name], [], 0
            for at in starts:
                stop = min(at + 2 * self.size[name], max(1, len(words) - SHINGLE + 1))
                hits += [(k, s) for k in range(max(at, done), stop) if (s := " ".join(words[k : k + SHINGLE])) in own]
                done = max(done, stop)
            out += [(name, share, a, min(b + SHINGLE, len(words)) - 1) for a, b, share in self.apart(hits, name)]
        return sorted(out, key=lambda x: (x[2], x[0]))

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its matches with character places."""
        words = [_WORD.findall(t.lower()) for t in texts]
        step = SEGMENT - 2 * self.most
        units: list[tuple[int, int, np.ndarray]] = []
        for k, w in enumerate(words):
            h = shingle_hashes(w, self.known)
            units += [(k, at, h[at : at + SEGMENT]) for at in range(0, max(1, len(h) - 2 * self.most), step) if len(h)]
        found: list[set] = [set() for _ in texts]
        while units:
            some, total = [], 0
            while units and (not some or total + len(units[-1][2]) <= SEGMENT):
                some.append(units.pop())
                total += len(some[-1][2])
            first = np.cumsum([0, *(len(h) for _, _, h in some[:-1])])
            for at, size, name in self.candidates(np.concatenate([h for _, _, h in some]), first):
                u = int(np.searchsorted(first, at, "right")) - 1
                found[some[u][0]].add((some[u][1] + at - int(first[u]), size, name))
        out = []
        for text, w, own in zip(texts, words, found, strict=True):
            matches = self.verify(w, own) if own else []
            places = [m.span() for m in _WORD.finditer(text)] if matches else []
            if matches and len(places) != len(w):  # lower-casing changed the words' number
                places = [m.span() for m in _WORD.finditer(text.lower())]
            out.append([(n, s, places[a][0], places[b][1]) for n, s, a, b in matches])
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, start, end): a row per template and place it is found at."""
    own = TEMPLATES if templates is None else templates

    def run(stream):
        scanner = Scanner(own)
        for big in stream:
            for batch in common.batches(big, 256):
                found = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
                rows = [(d, *m) for d, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])

    return common.narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCH)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
