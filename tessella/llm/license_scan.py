"""License scans: winnowed template fingerprints, then banded alignment.

Each template's words are fingerprinted by hashes of GRAM neighbouring words,
thinned by winnowing: of each WINDOW neighbouring hashes the least stays, so
any run of GRAM + WINDOW - 1 template words that a text copies shares a
fingerprint with it.  Of a template of SHORT words or fewer, more single words
are also indexed than a match may lack, so every match has one.  An inverted index maps fingerprints to places in
templates.  All word runs of a text are looked up in it; hits of one template
on diagonals within BAND of each other make a candidate, which a local
alignment within a band around these turns into a matched span and its
coverage.  Where matches of several templates overlap, the best one stays.

Templates are a parameter of fixed size, sent to the executors; texts are
scanned whole and independently, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.cluster import lean, slices

GRAM, WINDOW = 3, 3
#: Words of the templates that single words are indexed of.
SHORT = 12
#: Half width of the band, in words, beside the diagonals of a candidate's hits.
BAND = 8
#: What a word inside a match that is not the template's counts for.
GAP = 0.25
#: Bytes of templates at most.
TEMPLATE_BYTES = 8 << 20

#: Short notices and license texts by SPDX identifier.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}

#: Bytes that separate words: everything below 0x80 that is no letter or digit.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z."""
    return (text or "").encode().translate(FOLD).split()


def byte_spans(text: str) -> list[tuple[int, int]]:
    """The byte offsets of each word."""
    import re

    return [m.span() for m in re.finditer(rb"[^ ]+", text.encode().translate(FOLD))]


class Index:
    """The inverted index of winnowed template fingerprints, and of single words of short templates."""

    def __init__(self, templates: dict[str, str], least: float = 0.8):
        import zlib

        import numpy as np

        self.names = sorted(templates)
        self.words = [words(templates[n]) for n in self.names]
        self.number: dict[bytes, int] = {}
        for t in self.words:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        base = len(self.number) + 1
        self.weights = np.array([base**2, base, 1], np.int64)
        places: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.words):
            ids = [self.number[w] for w in t]
            grams = [(ids[i] * base + ids[i + 1]) * base + ids[i + 2] for i in range(len(ids) - 2)]
            order = [zlib.crc32(str(g).encode()) for g in grams]
            picked = {min(range(s, min(s + WINDOW, len(grams))), key=lambda i: (order[i], -i)) for s in range(max(1, len(grams) - WINDOW + 1))} if grams else set()
            for i in picked:
                places.setdefault(grams[i], []).append((k, i))
        self.grams = np.array(sorted(places), np.int64)
        self.places = [places[g] for g in sorted(places)]
        # words in few templates, and then long ones, are taken for rare in texts
        spread = Counter(w for t in self.words for w in set(t))
        self.single: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.words):
            if len(t) <= SHORT:
                need = sum(m < least * len(t) for m in range(len(t) + 1))  # matched words of a match at least
                for i in sorted(range(len(t)), key=lambda i: (t[i].isdigit(), spread[t[i]], -len(t[i]), i))[: len(t) - need + 1]:
                    self.single.setdefault(self.number[t[i]], []).append((k, i))
        self.is_single = np.zeros(base, bool)
        self.is_single[list(self.single)] = True

    def hits(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the text) of all shared fingerprints and single words."""
        import numpy as np

        n = len(text)
        if not n or not len(self.grams):
            return []
        of = self.number.get
        ids = np.fromiter((of(w, 0) for w in text), np.int64, n)
        alone = np.flatnonzero(self.is_single[ids])
        found = [(k, i, p) for p in alone.tolist() for k, i in self.single[int(ids[p])]]
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return found
        grams = ids[at] * self.weights[0] + ids[at + 1] * self.weights[1] + ids[at + 2]
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        same = np.flatnonzero(self.grams[slot] == grams)
        return found + [(k, i, p) for s, p in zip(slot[same].tolist(), at[same].tolist()) for k, i in self.places[s]]

    def scan(self, text: list[bytes], least: float) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first word, end word) of each match, by place."""
        import numpy as np

        found: set = set()
        by: dict[int, list[tuple[int, int]]] = {}
        for k, i, p in self.hits(text):
            by.setdefault(k, []).append((p - i, p))
        ids = np.fromiter((self.number.get(w, 0) for w in text), np.int64, len(text)) if by else None
        for k, hits in by.items():
            template = self.words[k]
            own = np.zeros(len(self.number) + 1, bool)
            own[[self.number[w] for w in template]] = True
            shared = np.concatenate([[0], np.cumsum(own[ids])])
            hits.sort()
            at = 0
            while at < len(hits):  # a band holds the diagonals within BAND of its first, and BAND beside them
                first = at
                while at < len(hits) and hits[at][0] - hits[first][0] <= BAND:
                    at += 1
                low, high = hits[first][0] - BAND, hits[at - 1][0] + BAND
                parts = [(max(0, low), min(len(text), len(template) + high))]
                while parts:  # it can hold several copies: go on beside each match
                    a, b = parts.pop()
                    if b <= a or shared[b] - shared[a] < least * len(template):
                        continue
                    matched, start, end = align(template, text, low, high, a, b)
                    if not matched:
                        continue
                    covered = matched / (len(template) + GAP * (end - start - matched))
                    if covered >= least:
                        found.add((self.names[k], covered, matched, start, end))
                    if covered >= least or end - start < b - a:
                        parts += [(a, start), (end, b)]
        return best_apart(found, {n: len(w) for n, w in zip(self.names, self.words)})


def best_apart(found, sizes: dict[str, int]) -> list:
    """The matches that no better one overlaps, by place.

    Better has more matched words, then fewer words of text and template that
    are not matched.  So one notice gives one license, the nearest.
    """
    from bisect import bisect

    def rank(m):
        name, _, matched, first, end = m
        return (-matched, end - first + sizes[name] - 2 * matched, first, end, name)

    starts: list[int] = []
    kept: list = []
    for m in sorted(found, key=rank):
        i = bisect(starts, m[3])
        if (i == 0 or kept[i - 1][4] <= m[3]) and (i == len(kept) or m[4] <= kept[i][3]):
            starts.insert(i, m[3])
            kept.insert(i, m)
    return kept


def align(template: list[bytes], text: list[bytes], low: int, high: int, start: int = 0, stop: int | None = None) -> tuple[int, int, int]:
    """Best local alignment on the diagonals low..high (text minus template place), in text[start:stop].

    Equal words gain 2, others and gaps cost 1.  Returns the matched words and
    the span of the text; of equal scores the first.
    """
    stop = len(text) if stop is None else stop
    best = (0, 0, 0, 0)  # score, matched, first, end
    nothing = (0, 0, -1)
    width = high - low + 1
    before = [nothing] * (width + 1)  # by diagonal; of the template word before
    for i, word in enumerate(template):
        now = [nothing] * (width + 1)
        for d in range(max(0, start - i - low), min(width, stop - i - low)):
            p = i + low + d
            s, m, first = before[d]
            if text[p] == word:
                cell = (s + 2, m + 1, p if s == 0 else first)
            else:
                cell = (s - 1, m, first)
            up = before[d + 1]  # a template word without a text word
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            left = now[d - 1] if d else nothing  # a text word without a template word
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] > 0:
                now[d] = cell
                if cell[0] > best[0] and text[p] == word:
                    best = (cell[0], cell[1], cell[2], p + 1)
        before = now
    return best[1:]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per license match: ``doc_id, license, coverage, matched_words,
    first_word, end_word, start_byte, end_byte``.

    ``coverage`` is the number of matched words, divided by the template's words
    and GAP for each other word in the span; at least ``least``.  Matches do not overlap: of
    several the one with most matched words counts, then the one with fewest
    others (:func:`best_apart`).  Spans are half open, in words as
    :func:`words` counts them and in bytes of UTF-8.  A text can hold several
    licenses, and one several times; null, empty and license-free texts give no
    rows, repeated rows give theirs each; time grows in proportion to a text.
    Templates of fewer than GRAM words have no fingerprint and are refused.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes")
    if any(len(words(t)) < GRAM for t in templates.values()):
        raise ValueError(f"a template has fewer than {GRAM} words")
    known = docs.sparkSession.sparkContext.broadcast(dict(templates))
    field = docs.schema[doc_id]
    schema = T.StructType([T.StructField("doc_id", field.dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())])
    for c in ("matched_words", "first_word", "end_word", "start_byte", "end_byte"):
        schema = schema.add(c, T.LongType())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(known.value, least)
        for batch in batches:
            for at, count in slices(batch.column(1)):
                part = batch.slice(at, count)
                rows, which = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = index.scan(words(t), least)
                    if found:
                        spans = byte_spans(t)
                        rows += [(*m, spans[m[3]][0], spans[m[4] - 1][1]) for m in found]
                        which += [i] * len(found)
                if rows:
                    types = [pa.string(), pa.float64(), *[pa.int64()] * 5]
                    cols = [pa.array(x, y) for x, y in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *cols], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), schema)
