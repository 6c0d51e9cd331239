"""Groups, links and counts against loops over whole-text tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tests_llm_rows import awkward_rows

from gaugeworks.llm import alignment

FILES = alignment.public_files()


@pytest.fixture(scope="module")
def whole():
    """Tokens (id, bytes) of a whole text under both, each in one call."""
    both = alignment.tokenizers(*FILES)

    def tokens(text):
        if not text:
            return [], []
        a = [(i, both.a_bytes[i]) for i in both.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, both.b_bytes[i]) for i in both.b.encode(text, num_threads=1)]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
            return [], []
        return a, b

    return tokens


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(tokens):
    """(groups as text, links as pairs of ids) by comparing all ranges."""
    a, b = map(ranges, tokens)
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    both = sorted({e for _, _, e in a} & {f for _, _, f in b})
    groups, low = [], 0
    for high in both:
        side = lambda x: ",".join(str(i) for i, s, e in x if low <= s and e <= high)
        groups.append(side(a) + "|" + side(b))
        low = high
    return ";".join(groups), links


TEXTS = ["one two  three\n\n four's don't\tfive ", " lead", "  ", " ", "a", "x \n y  z 　 w", "▁ x", "a▁b",
         "<s> </s> <|endoftext|> <0x41>", "日本語 テキスト ünï é \U0001f600\U0001f600", "ab" * 400, "1234567 12,345.67",
         "tail   ", "\x1c \x1f a\x00b \x85 c", "don't it's we'll I'D"]


@pytest.mark.parametrize("chars", [1, 12, 16_384])
def test_stretches_tokenize_as_the_whole(whole, chars, monkeypatch):
    monkeypatch.setattr(alignment, "_STRETCH_CHARS", chars)
    both = alignment.tokenizers(*FILES)
    rng = random.Random(3)
    stock = ["a", "Be", "'s", " ", "  ", "\n", "\t", "é", "日本", ".", "12", " ", " ", "🙂", "<s>", "ing", "\r\n"]
    texts = TEXTS + ["".join(rng.choice(stock) for _ in range(40)) for _ in range(400)]
    for text, got in zip(texts, both.texts(texts)):
        a, b = whole(text)
        assert (got is None) == (not a)
        if got is not None:
            assert got[0].tolist() == [i for i, _ in a] and got[2].tolist() == [i for i, _ in b]
            assert got[1].tolist() == [len(t) for _, t in a] and got[3].tolist() == [len(t) for _, t in b]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_align_ranges(a, b):
    a = a + [max(0, sum(b) - sum(a)) or 1]
    b = b + [sum(a) - sum(b)] if sum(a) > sum(b) else b
    a, b = np.array(a), np.array(b)
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    got = alignment.align(a_end - a, a_end, b_end - b, b_end)
    assert list(zip(got.a.tolist(), got.b.tolist())) == [
        (i, j) for i in range(len(a)) for j in range(len(b))
        if a_end[i] - a[i] < b_end[j] and b_end[j] - b[j] < a_end[i]]
    if a_end[-1] == b_end[-1]:
        assert got.group[-1] + 1 == len(set(a_end.tolist()) & set(b_end.tolist()))


def expected_rows(docs, whole):
    made = [(i, *plain(tokens), tokens) for i, t in docs for tokens in [whole(t)]]
    counts = Counter(p for _, _, links, _ in made for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return Counter(
        (i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "",
         sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links))
        for i, groups, links, (a, b) in made)


@pytest.mark.parametrize("chunk", [1, 200, 10**6])
def test_documents(spark, awkward, whole, chunk):
    rows = [(i, t[:3000] if t else t) for i, t, *_ in awkward_rows()] + list(enumerate(TEXTS * 2, 500))
    docs = awkward.select("doc_id", "text", "id", "n", "copy").limit(0).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    assert Counter(map(tuple, alignment.align_documents(docs, chunk_tokens=chunk).collect())) == expected_rows(
        rows, whole)


def test_query(spark, folder, awkward, whole):
    docs = awkward.filter("length(text) < 5000 OR text IS NULL")
    out = alignment.op13_align(spark, folder(documents=docs))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(map(tuple, out.collect())) == expected_rows(
        [(r["doc_id"], r["text"]) for r in docs.collect()], whole)


def test_very_long_text(spark, empty):
    text = "αβγ δε 日本語 " * 60_000 + "x" * 200_000
    out = alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_links"] >= max(out["n_a"], out["n_b"]) and out["n_a"] > 200_000
    assert alignment.align_documents(empty).count() == 0


def test_spans():
    text = "Hello wörld's 日本"
    raw = (" " + text).encode()
    both = alignment.tokenizers(*FILES)
    found = alignment.spans(text)
    assert found[0][0] == 0 and found[-1][1] == len(raw) and alignment.spans("") == alignment.spans(None) == []
    for start, stop, a, b in found:
        assert b"".join(both.a_bytes[i] for i in a) == raw[start:stop] == b"".join(both.b_bytes[i] for i in b)
