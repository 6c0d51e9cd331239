"""Top-k, decontamination, line removal and license scan against plain Python."""

import math
import random

import pytest
from tests_llm_rows import awkward_rows, words

from gaugeworks.llm import decontamination, licenses, linededup, topk


def plain_topk(rows, k):
    vectors = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
               if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {v for v in vectors if v[0] % 100 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "SHARE_BLOCKS", 2)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in range(301)]
    rows += [(400 + i, [0.5 * scale, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]  # ties
    rows += [(None, [1.0] * 6), (500, None), (600, [1.0, None] + [0.0] * 4), (601, [float("nan")] * 6),
             (602, [float("inf")] * 6), (700, []), (800, [1.0, 2.0]), (801, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    parts = topk.quantized(frame)
    got = topk.top_k(parts.filter("vec_id % 100 = 0"), parts, 10).collect()
    assert {tuple(r) for r in got} == plain_topk(rows, 10) and len(got) == len(plain_topk(rows, 10))


def test_topk_of_nothing(spark):
    parts = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(parts, parts, 10).collect() == []


def plain_contained(docs, items, least=0.8):
    out = []
    for doc, text, *_ in docs:
        for item, wanted in {(i, t) for i, t in items}:
            want = decontamination.shingle_set(wanted)
            own = decontamination.shingle_set(text, min(5, len(decontamination.words(wanted))) or 5)
            if want and len(want & own) >= least * len(want) - 1e-9:
                out.append((doc, item, len(want), len(want & own)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("block", [500_000, 20])
def test_contained_items(spark, awkward, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_HASHES", block)
    long = awkward_rows()[4][1].split()
    items = [(0, " ".join(long[500:540])), (1, " ".join(long[700:730]).upper() + "!"), (2, None), (3, ""), (4, "one"),
             (4, "one"), (5, "no id here at ALL"), (6, words(99, 50)), (None, " ".join(long[60:100])),
             # four in five of its shingles, and just under that
             (7, " ".join(long[900:939]) + " " + words(5, 8, 10**6)),
             (8, " ".join(long[900:930]) + " " + words(6, 12, 10**6))]
    items += [(100 + i, " ".join(long[i * 9:i * 9 + 5 + i])) for i in range(60)]
    # Fewer words than a shingle has, within long texts.
    items += [(200 + n, " ".join(long[3000:3000 + n])) for n in range(1, 5)] + [(210, "No ID"), (211, "here all")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contained(awkward, frame).collect()
    expected = plain_contained(awkward_rows(), items)
    assert order(map(tuple, got)) == order(expected)
    assert {7, 201, 202, 203, 204, 210} <= {r[1] for r in expected} and not {8, 211} & {r[1] for r in expected}
    left = decontamination.without_items(awkward, frame)
    hit = {(r[0]) for r in expected}
    assert left.columns == awkward.columns
    assert order((r["doc_id"],) for r in left.collect()) == order((d,) for d, *_ in awkward_rows() if d not in hit)


def test_sketch_cannot_miss():
    for n in range(1, 400):
        lacking = n - math.ceil(0.8 * n - 1e-9)
        assert decontamination.sketch_size(n, 0.8) == lacking + 1


def test_no_items_no_documents(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contained(awkward, none).collect() == []
    assert decontamination.contained(empty, some).collect() == []
    assert decontamination.without_items(awkward, none).count() == awkward.count()


def plain_lines(docs, sites):
    where, first = {}, {}
    for doc, text, _, site in docs:
        for line in (text.split("\n") if text is not None else []):
            key = line.strip(" ")
            if key:
                where.setdefault(key, set()).update({site} - {None})
                if doc is not None:
                    first[key] = min(doc, first.get(key, doc))
    common = {k for k, s in where.items() if len(s) >= sites}
    out = []
    for doc, text, *_ in docs:
        if text is None:
            out.append((doc, None, 0))
            continue
        kept = [x for x in text.split("\n")
                if x.strip(" ") not in common or first.get(x.strip(" ")) == doc]
        out.append((doc, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("sites", [1, 2, 4, 30])
def test_lines(spark, awkward, sites):
    rows = awkward_rows()
    for n in range(1, 45):  # lines on n sites, among lines of their own
        rows += [(1000 + 50 * n + i, f"head {n} {i}\n  shared line {n} \nshared line {n}\ntail", "en", f"site{i}")
                 for i in range(n)]
    frame = spark.createDataFrame([(*r, "v") for r in rows],
                                  "doc_id long, text string, lang string, source string, line string")
    got = linededup.dedup_lines(frame, sites)
    assert [f.name for f in got.schema["doc"].dataType] == frame.columns
    got = [(r["doc"]["doc_id"], r["doc"]["text"], r["removed"]) for r in got.collect()]
    assert order(got) == order(plain_lines(rows, sites))


def test_no_lines(empty):
    assert linededup.dedup_lines(empty).collect() == []


def test_licenses(spark, awkward, empty):
    mit = licenses.TEMPLATES["MIT"]
    gpl = licenses.TEMPLATES["GPL-3.0"]
    damaged = gpl.replace("General", "Genral").replace("version", "verson")
    rows = [(1, f"x\n{mit.upper()}\ny {mit}"), (2, words(2, 3000) + " ÄÖ " + damaged + words(3, 3000)), (3, None),
            (4, ""), (5, "İİ " + gpl), (6, "Licensed under the sky, version 2.0 of clouds")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    got = sorted((r["doc_id"], r["license"], texts[r["doc_id"]][r["start"]:r["end"]]) for r in found)
    assert got == [(1, "MIT", mit.upper()[:-1]), (1, "MIT", mit[:-1]), (2, "GPL-3.0", damaged[:-1]),
                   (5, "GPL-3.0", gpl[:-1])]
    assert all(0.9 <= r["coverage"] <= 1 for r in found)
    assert licenses.scan(awkward).collect() == [] and licenses.scan(empty).collect() == []
    short = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"s": "mit", "none": ""})
    assert [r["doc_id"] for r in short.collect()] == [1, 1]


def test_licenses_with_words_put_in_or_left_out():
    held = licenses.Templates(licenses.TEMPLATES)
    grant, header = licenses.TEMPLATES["MIT-grant"], licenses.TEMPLATES["Apache-2.0-header"]
    for name, text in (
            ("MIT-grant", grant.replace("any person", "any person or legal entity")),
            ("MIT-grant", grant.replace("any person", "any person, company or other legal entity here")),
            ("MIT-grant", grant.replace("free of charge, ", "without any fee and free of all charge whatsoever, ")),
            ("Apache-2.0-header", header.replace("you may not", "and so you and your own people may not")),
            ("Apache-2.0-header", header.replace("Version 2.0 ", ""))):
        text = words(5, 300) + " " + text + " " + words(6, 300)
        got = [m for m in held.matches(text) if m[0] == name]
        assert len(got) == 1 and got[0][1] >= 0.8 * got[0][2], (name, text)
    assert not [m for m in held.matches(grant.replace("any person", "any " + words(1, 30) + " person"))]


def plain_alignment(template, text, gain=1):
    """(score, matched) of the best local alignment, cell by cell."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for a in template:
        row = [(0, 0)]
        for j, b in enumerate(text, 1):
            across = (above[j - 1][0] + gain, above[j - 1][1] + 1) if a == b else (above[j - 1][0] - 1, above[j - 1][1])
            row.append(max(across, (above[j][0] - 1, above[j][1]), (row[-1][0] - 1, row[-1][1]), (0, 0)))
        best, above = max(best, *row), row
    return best


def damaged(text, errors, rng):
    """``text`` with so many letters changed, put in or left out."""
    letters = list(text)
    for _ in range(errors):
        at = rng.randrange(len(letters))
        letters[at] = rng.choice(("", rng.choice("qxz"), letters[at] + rng.choice("qxz")))
    return "".join(letters)


def test_wide_band_is_a_full_alignment():
    rng = random.Random(5)
    template = licenses.normal(licenses.TEMPLATES["MIT"] + licenses.TEMPLATES["CC-BY-NC-4.0"])[0]
    for errors in range(0, 30, 3):
        text = licenses.normal(words(1, 4) + damaged("".join(map(chr, template)), errors, rng) + words(2, 3))[0]
        for gain in (1, 2, 4):
            got = licenses.align(template, text, 0, band=len(text) + len(template), gain=gain)
            score, _ = plain_alignment(template.tolist(), text.tolist(), gain)
            assert got.score + (gain - 1) * got.matched == score


def test_licenses_recall():
    """Found in place by candidates and bands, of what a full alignment accepts."""
    rng, held = random.Random(6), licenses.Templates(licenses.TEMPLATES)
    should, found = {}, {}
    for name in ("MIT-grant", "Apache-2.0-header", "BSD-redistribution", "GPL-3.0"):
        template = held.texts[held.names.index(name)]
        plain = "".join(map(chr, template))
        for case in range(60):
            rate = (0.02, 0.05, 0.1, 0.15, 0.2)[case % 5]
            text = words(case, 5) + " " + damaged(plain, round(rate * len(plain)), rng) + " " + words(case + 1, 5)
            raw, size = licenses.normal(text)[0], len(template)
            whole = [licenses.align(template, raw, 0, len(raw) + size, gain) for gain in (1, 2, 4)]
            if any(a and a.matched >= 0.8 * size - 1e-9 and a.score >= 0.6 * size - 1e-9 for a in whole):
                should[rate] = should.get(rate, 0) + 1
                found[rate] = found.get(rate, 0) + any(m[0] == name for m in held.matches(text))
    assert all(found[r] == should[r] for r in (0.02, 0.05, 0.1)), (should, found)
    assert sum(found.values()) >= 0.9 * sum(should.values()) and should[0.15] >= 10, (should, found)
    print(should, found)
