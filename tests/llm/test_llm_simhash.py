"""Fingerprints bit by bit, and components against all pairs."""

import random
import re

import numpy as np
import xxhash
from tests_llm_rows import CLASHING, awkward_rows, words

from gaugeworks.llm import simhash


def plain(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    found = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in found]
    grams = [b" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", "  \n", "One", "One two", "a B c", "É é\xa0x A b c d", words(3, 500)):
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)


def roots(items, linked):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near_fingerprints():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    out = set(base)
    for b in base[:20]:  # chains, and one crowded ball
        for _ in range(12 if b != base[0] else 120):
            b = b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.7 else base[0] ^ (
                1 << rng.randrange(64))
            out.add(b)
    return sorted(out)


def test_links_connect_what_is_linked(spark):
    fps = near_fingerprints()
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for rows in (10**6, 7):  # whole groups, and groups cut into chunks
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, group_rows=rows)).collect()}
        got = [found.get(f, f) for f in signed]
        assert len(set(zip(expected, got))) == len(set(expected)) == len(set(got))


def test_components_of_documents(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    texts = awkward_rows()
    assert len(rows) == len(texts)
    fps = [plain(t) for _, t, *_ in texts]
    root = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (doc, *_), r in zip(texts, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    expected = sorted((doc is None, doc or 0, fps[i], least.get(root[i])) for i, (doc, *_) in enumerate(texts))
    assert expected == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & (2**64 - 1), r["component_id"])
                              for r in rows)


def test_one_of_each_component_stays(spark, awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and set(CLASHING) <= set(kept.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(
        {r["component_id"] for r in simhash.near_duplicates(awkward).collect() if r["component_id"] is not None})
    assert ids.count(None) == 1
    assert simhash.keep_one(empty).collect() == [] and simhash.near_duplicates(empty).collect() == []


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, words(1, 50)), (1, words(2, 50)), (2, words(2, 50)), (None, words(3, 50))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in rows})
