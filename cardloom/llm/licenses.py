"""Licence scan by a positional index of rare words.

Templates are notices of well-known licences. Over all documents it is counted how many hold each word of the templates; a
template's words rank by their idf. A file is looked up by the rarest word of each template's mandatory phrases, which any
match must hold; each place of it, less its place in the template, is where a match may start. Starts on which too few of the
template's rarest words in the file agree, by their relative position, go. The others are verified: every mandatory phrase has to
stand in the stretch, and enough of the template's words about where they belong.

A template t of m words matches a file from word s on if
 1. its lead (the word of highest idf in its mandatory phrases, ties to the lesser word) stands at s + its first place in t,
 2. of the RARE words of t with the highest idf that the file holds, at least half stand within DRIFT words of s + a place in t,
 3. each mandatory phrase stands, its words next to each other, within the words from s - DRIFT to s + m + DRIFT,
 4. coverage, the share of t's places whose word stands within DRIFT words of s + place, is at least LEAST.
Short phrases are templates that are mandatory as a whole, and match wherever they stand.

Cases: a null text counts as empty, has no words, no labels and the score 0; null ids, repeated ids and repeated rows each keep
their own row; ties of coverage don't matter, as labels are a set and the score is the highest; texts of any length are scanned
whole, at a cost of their length and of the starts in them; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE, DRIFT, LEAST = 4, 4, 0.6
#: A word of lower-cased UTF-8: runs of what isn't ASCII, or is an ASCII letter or digit.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: Phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory phrases.
NOTICES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("except in compliance with the license", "apache org licenses license 2 0")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    ("bsd", "Use of this source code is governed by a BSD-style license", ("governed by a bsd style license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "v 2 0")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution", "international license")),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright and related or neighboring rights")),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher", ("no part of this publication may be reproduced", "prior written permission")),
)

MATCHES = "array<struct<label string, start long, coverage double>>"


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower())  # bytes.lower() is of A-Z only


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    whole: bool

    @classmethod
    def of(cls, label: str, text: str, keys: tuple[str, ...] = ()) -> Template:
        own = tuple(words_of(text))
        return cls(label, own, tuple(tuple(words_of(k)) for k in keys) or (own,), not keys)


def templates(phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> list[Template]:
    return [*(Template.of(v, k) for k, v in phrases.items()), *(Template.of(*n) for n in notices)]


def idf_of(docs: DataFrame, known: list[Template], text_col: str = "text") -> dict[bytes, float]:
    """idf of each word of the templates, over all documents. What comes to the driver is bounded by the templates' words."""
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            for text in b.column(0):
                if text := text.as_py():
                    n.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*n, None], pa.binary()), pa.array([*n.values(), rows], pa.int64())], names=["word", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = {bytes(r["word"]) if r["word"] is not None else None: r["n"] for r in sums}
    total = held.get(None, 0)
    return {w: math.log((1 + total) / (1 + held.get(w, 0))) for w in vocabulary}


class Index:
    """Templates by the lead word of each, words of each by falling idf."""

    def __init__(self, known: list[Template], idf: dict[bytes, float]):
        rank = lambda w: (-idf[w], w)
        self._leads: dict[bytes, list[tuple]] = {}
        self._anchors: dict[tuple[bytes, ...], int] = {k: min(range(len(k)), key=lambda i: rank(k[i])) for t in known for k in t.keys}  # noqa: B023
        for t in known:
            lead = min({w for k in t.keys for w in k}, key=rank)
            places: dict[bytes, list[int]] = {}
            for q, w in enumerate(t.words):
                places.setdefault(w, []).append(q)
            self._leads.setdefault(lead, []).append((t, sorted(places, key=rank), places))
        self._words = {w for t in known for w in t.words}

    @staticmethod
    def _near(at: list[int], place: int, drift: int) -> bool:
        i = bisect_left(at, place - drift)
        return i < len(at) and at[i] <= place + drift

    def _phrase(self, key: tuple[bytes, ...], words: list[bytes], held: dict[bytes, list[int]]) -> list[int]:
        """Where the phrase stands: places of its rarest word whose neighbours are the others."""
        k, n = self._anchors[key], len(key)
        want = list(key)
        return [p - k for p in held.get(key[k], ()) if p >= k and words[p - k : p - k + n] == want]

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float, bool]]:
        """(label, start, coverage, whether of a phrase)."""
        held: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in self._words:
                held.setdefault(w, []).append(p)
        found, stands = [], {}
        for lead in self._leads.keys() & held.keys():
            for t, ranked, places in self._leads[lead]:
                keys = [stands[k] if k in stands else stands.setdefault(k, self._phrase(k, words, held)) for k in t.keys]
                if not all(keys):
                    continue
                if t.whole:
                    found += [(t.label, p, 1.0, True) for p in keys[0]]
                    continue
                rare = [w for w in ranked if w in held][:RARE]
                m = len(t.words)
                for p in held[lead]:
                    s = p - places[lead][0]
                    if 2 * sum(any(self._near(held[w], s + q, DRIFT) for q in places[w]) for w in rare) < len(rare):
                        continue
                    if not all((i := bisect_left(at, s - DRIFT)) < len(at) and at[i] + len(k) <= s + m + DRIFT for at, k in zip(keys, t.keys, strict=True)):
                        continue
                    cover = sum(w in held and self._near(held[w], s + q, DRIFT) for q, w in enumerate(t.words)) / m
                    if cover >= LEAST:
                        found.append((t.label, s, cover, False))
        return found


def scan(docs: DataFrame, known: list[Template] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word and last_word of the phrases, base_labels, labels, score, matches."""
    known = templates() if known is None else known
    idf = idf_of(docs, known, text_col)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known, idf)
        for b in batches:
            out = []
            for text in b.column(1):
                words = words_of(text.as_py() or "")
                found = index.matches(words)
                starts = [s for _, s, _, phrase in found if phrase]
                base, every = {x[0] for x in found if x[3]}, {x[0] for x in found}
                spans = [{"label": x[0], "start": x[1], "coverage": x[2]} for x in sorted(found)]
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), max((x[2] for x in found), default=0.0), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=names)

    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return light.mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCHES}")
