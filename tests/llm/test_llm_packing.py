"""Packing against the tokenizer itself and a plain best-fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests_llm_rows import awkward_rows
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import packing
from gaugeworks.llm.base import staged

FILES = packing.public_files()


ROWS = awkward_rows()
WHOLE = Tokenizer.from_file(FILES[0])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert packing.encoder(*FILES).ids(text) == WHOLE.encode(text, add_special_tokens=False).ids


def check_layout(rows, tokens=1024):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    return held


def test_documents_are_cut_and_packed(awkward):
    rows = packing.pack_documents(awkward).collect()
    held = check_layout(rows)
    expected, total = Counter(), 0
    for doc, text, *_ in ROWS:
        ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        total += len(ids)
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0] + list(range(first, len(ids), 1024))
        for k, (a, b) in enumerate(zip(starts, starts[1:] + [len(ids)])):
            expected[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert expected == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert len(held) <= -(-total // 1024) + 1


def test_no_documents(empty):
    assert packing.pack_documents(empty).collect() == []


def test_sequences_give_the_ids_back(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    made = staged(packing.pieces(docs, FILES, keep_ids=True), "pieces")
    (row,) = packing.sequences(packing.pack(made)).collect()
    one, two = ([*WHOLE.encode(t, add_special_tokens=False).ids, 2] for t in ("a b c", "d e"))
    assert row["ids"] == one + two


def place_all(counts, capacity, choose="norm", weights=(1.0, 1.0, 1.0)):
    plan = packing.best_fit(counts, capacity, choose, weights)
    bins = defaultdict(list)
    for length, n in counts.items():
        seq, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq, offset):
            bins[int(s)].append((int(o), length))
    assert sorted(bins) == list(range(plan.sequences))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
    return bins


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_capacity_holds(choose):
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 101) for _ in range(3000))
    capacity = packing.Capacity(tokens=100, documents=4, cost=5200)
    for parts in place_all(counts, capacity, choose, (1.0, 2.0, 0.5)).values():
        assert sum(n for _, n in parts) <= 100 and len(parts) <= 4
        assert len(parts) == 1 or sum(n * n for _, n in parts) <= 5200


def test_as_good_as_plain_best_fit():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 1025) for _ in range(2000)]
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [i for i, left in enumerate(bins) if left >= n]
        if room:
            bins[min(room, key=lambda i: bins[i])] -= n
        else:
            bins.append(1024 - n)
    assert len(place_all(Counter(lengths), packing.Capacity())) <= len(bins)
