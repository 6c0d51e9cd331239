"""License scan: winnowed fingerprints, then banded alignment.

Texts are compared by their letters and digits alone, lower-cased.  A
template's fingerprints are the least hash of every ``WINDOW`` successive
k-grams; they and their places make up an inverted index.  All k-grams of a
document are looked up in it, so that any stretch a document shares with a
template over ``GRAM + WINDOW - 1`` characters is met.  Hits on nearby
diagonals are one candidate, and a banded local alignment around it reports how
much of the template the document has and from where to where.  The band holds
as many letters put in or left out as the coverage leaves.

A match needs ``COVERAGE`` of the template, and no more errors than that leaves.  All
matches that share a fingerprint with the template are returned; one whose errors
lie so evenly that no stretch of ``GRAM + WINDOW - 1`` letters is whole may share
none, and is lost.  Of texts with random errors that a full alignment accepts, a test
measures how many are found: all up to one error in ten letters, 0.9 or more at
any rate that may match.  A template that occurs twice gives two matches; of
overlapping matches of one template the best stays.  Null and empty texts match nothing, repeated rows repeat their
matches, and an empty table of documents or templates gives none.  Templates
shorter than a k-gram are looked for as they are, whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import prepare, query, table

GRAM, WINDOW, BAND, COVERAGE = 8, 4, 12, 0.8

# Notices by which public licenses are referred to.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                         "file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_KEPT = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_P = 0x100000001B3


def lowered(text: str) -> bytes:
    """A text in lower case, character by character: places stay as they are."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.encode()


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the letters and digits of a text, and their places in its UTF-8."""
    raw = np.frombuffer(lowered(text), np.uint8)
    at = np.flatnonzero(_KEPT[raw])
    return raw[at], at


def grams(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all ``size``-grams (a power of two) of ``raw``."""
    value, width, factor = raw.astype(np.uint64) + np.uint64(1), 1, _P
    while width < size:
        value = value[:-width] * np.uint64(factor) + value[width:]
        width, factor = width * 2, factor * factor % (1 << 64)
    value = value * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash (the rightmost, of equals) of every window."""
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else []
    found = []
    for at in range(len(hashes) - window + 1):
        part = hashes[at:at + window]
        found.append(at + window - 1 - int(np.argmin(part[::-1])))
    return sorted(set(found))


@dataclass
class Alignment:
    matched: int
    start: int  # in the normal text
    end: int
    score: int


def width_of(size: int, coverage: float, band: int = BAND) -> int:
    """How far a match may get from a hit of its candidate: by its errors, and
    by the diagonals that make one candidate."""
    return max(band, math.floor(2 * (1 - coverage) * size + 1e-9) + band // 2)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND, gain: int = 1) -> Alignment | None:
    """Best local alignment with text place - template place within ``band`` of
    ``diagonal``; ``gain`` for a match, -1 for a mismatch or gap.  The score
    counts a match as 1 whatever the gain, which carries over longer gaps.

    A row is a template place, a column an offset in the band.  Ties take the
    longer run of matches, then the earlier start.
    """
    width = 2 * band + 1
    offset = np.arange(width)
    # A cell's value, matches and start in one number, compared as such.
    shift_m, shift_s = 1 << 20, 1 << 40
    none = np.int64(0)
    cell = np.zeros(width, np.int64)  # score * 2**40 + matches * 2**20
    start = np.zeros(width, np.int64)
    best = None
    top = np.int64(0)
    for i in range(len(template)):
        at = i + diagonal - band + offset
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == template[i]
        fresh = cell < shift_s  # nothing worth going on with
        base = np.where(fresh, none, cell)
        begin = np.where(fresh, at, start)
        across = np.where(same, base + gain * shift_s + shift_m, base - shift_s)
        down = np.r_[cell[1:], none] - shift_s  # template place without a text place
        use = down > across
        now = np.where(use, down, across)
        begin = np.where(use, np.r_[start[1:], 0], begin)
        # Text places without a template place: the best cell to the left, less the way.
        lifted = now + offset * shift_s
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, offset, 0))
        begin = begin[source]
        now = np.where(inside & (reach - offset * shift_s >= shift_s), reach - offset * shift_s, none)
        cell, start = now, begin
        k = int(np.argmax(cell))
        if cell[k] > top:
            top = cell[k]
            score, matched = int(top >> 40), int((top & (shift_s - 1)) >> 20)
            best = Alignment(matched, int(start[k]), int(at[k]) + 1, score - (gain - 1) * matched)
    return best


class Templates:
    """Normal texts and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.texts = [normal(templates[n])[0] for n in self.names]
        postings = defaultdict(list)
        for t, raw in enumerate(self.texts):
            hashes = grams(raw) if len(raw) >= GRAM else np.zeros(0, np.uint64)
            for at in winnow(hashes):
                postings[int(hashes[at])].append((t, at))
        self.postings = dict(postings)
        self.hashes = np.array(sorted(postings), np.uint64)
        self.top = np.zeros(1 << 16, bool)
        self.top[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.short = [t for t, raw in enumerate(self.texts) if 0 < len(raw) < GRAM]

    def candidates(self, raw: np.ndarray, band: int) -> set[tuple[int, int]]:
        """(template, diagonal) of stretches worth aligning, one for each run of
        diagonals less than a band apart."""
        hits = defaultdict(list)
        if len(raw) >= GRAM and len(self.hashes):
            hashes = grams(raw)
            some = np.flatnonzero(self.top[(hashes >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            for at in some[self.hashes[place] == hashes[some]]:
                for t, tat in self.postings[int(hashes[at])]:
                    hits[t].append(int(at) - tat)
        for t in self.short:
            word, size = self.texts[t], len(self.texts[t])
            if len(raw) >= size:
                same = np.logical_and.reduce([raw[k:len(raw) - size + 1 + k] == word[k] for k in range(size)])
                hits[t] += np.flatnonzero(same).tolist()
        found = set()
        for t, diagonals in hits.items():
            last = None
            for d in sorted(set(diagonals)):
                if last is None or d - last > band // 2:
                    found.add((t, d))
                    last = d
        return found

    def matches(self, text: str, coverage: float = COVERAGE, band: int = BAND):
        """(name, matched, size, start, end) with places in characters of the text."""
        raw, at = normal(text)
        found = defaultdict(list)
        for t, diagonal in self.candidates(raw, band):
            size = len(self.texts[t])
            for gain in (1, 2, 4):
                got = align(self.texts[t], raw, diagonal, width_of(size, coverage, band), gain)
                # As many errors as the coverage leaves room for, and no more.
                if not got or got.score < (2 * coverage - 1) * size - 1e-9:
                    break
                if got.matched >= coverage * size - 1e-9:
                    found[t].append(got)
                    break
        whole = None
        for t in sorted(found):
            taken: list[Alignment] = []
            for got in sorted(found[t], key=lambda g: (-g.score, g.start)):
                if all(got.end <= other.start or got.start >= other.end for other in taken):
                    taken.append(got)
            for got in sorted(taken, key=lambda g: g.start):
                whole = whole or lowered(text)
                start = len(whole[:at[got.start]].decode())
                end = start + len(whole[at[got.start]:at[got.end - 1] + 1].decode(errors="ignore"))
                yield self.names[t], got.matched, len(self.texts[t]), start, end


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, end) of every match.  The templates are
    the caller's, held whole by each worker."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches):
        for batch in batches:
            out = [(doc, name, matched / size, start, end)
                   for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text
                   for name, matched, size, start, end in held.value.matches(text, coverage)]
            columns = zip(*out) if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["doc_id", "license", "coverage", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, license string, coverage double, start long, end long")


@query("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
