"""The pipeline against its stages in plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests_llm_rows import CLASHING, awkward_rows, words
from test_llm_packing import WHOLE, check_layout
from test_llm_search import plain_contained, plain_lines
from test_llm_simhash import plain as fingerprint, roots

import corpus_pipeline
from gaugeworks.llm import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rows_of_documents():
    """(doc_id, text, lang, source), with something for every stage to find."""
    rng = random.Random(8)
    rows = awkward_rows()
    for i in range(30):  # toxic ones have words of their own
        rows.append((200 + i, words(200 + i, 60) + f" foul{i % 3} vile{i % 4} " * 3, "en", f"s{i % 5}"))
    boiler = words(77, 9, 9000)
    for i in range(12):  # one line on twelve sites
        rows.append((300 + i, f"{words(300 + i, 70, 3000)}\n{boiler}\n{words(400 + i, 20, 3000)}", "en", f"site{i}"))
    for i in range(10):  # copies, and copies with one word changed in many
        text = words(500 + i, 400, 5000)
        other = text.split()
        other[rng.randrange(400)] = "changed"
        rows += [(520 + 3 * i, text, "de", "c"), (521 + 3 * i, text, "de", "d"), (522 + 3 * i, " ".join(other), "de", "c")]
    for i in range(6):
        rows.append((600 + i, words(600 + i, 40, 7000) + " " + ITEMS[i % 3][1] + " " + words(700 + i, 40, 7000), "en", "b"))
    return rows


ITEMS = [(i, words(9000 + i, 30, 10**6)) for i in range(3)] + [(9, None), (10, "")]


def kept_of_each(rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    groups = {}
    for row, root in zip(rows, roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)):
        groups.setdefault(root, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = rows_of_documents()
    made = [(*r, len(r[1]) if r[1] is not None else None) + ("v",) * len(CLASHING) for r in rows]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + extra) \
        .repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int(200 <= i < 230)) for i, *_ in rows if i is not None] + [(None, 0, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_run(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    score = {(r["doc_id"], r["text"]): r["score"] for r in docs.select("doc_id", "text").join(
        toxicity.scores(docs, toxicity.learn(spark, docs, folder)).distinct(), "doc_id").collect()}
    clean = [r for r in rows if score.get((r[0], r[1]), 0.0) < 0.5]
    assert len(rows) > len(clean) >= len(rows) - 30 and not [r for r in clean if r[0] and 200 <= r[0] < 230]
    lines = [(i, text, *rest) for (i, text, _), (_, _, *rest) in zip(plain_lines(clean, 6), clean)]
    one = kept_of_each(lines)
    assert len(one) <= len(lines) - 20
    hit = {i for i, *_ in plain_contained(one, ITEMS)}
    left = [r for r in one if r[0] not in hit]
    assert hit == set(range(600, 606))
    expected = Counter()
    for doc, text, *_ in left:
        ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0] + list(range(first, len(ids), 1024))
        for k, (a, b) in enumerate(zip(starts, starts[1:] + [len(ids)])):
            expected[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    packed = corpus_pipeline.run(spark, folder).collect()
    check_layout(packed)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected


def test_stages_keep_the_columns(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty_documents(spark, tables, folder):
    place, _ = tables
    read = lambda name: spark.read.parquet(f"{place}/{name}.parquet")
    at = folder(documents=read("documents").limit(0), labels=read("labels"), benchmark=read("benchmark"))
    assert corpus_pipeline.run(spark, at).collect() == []
