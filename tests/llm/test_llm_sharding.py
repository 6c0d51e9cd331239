"""Shards against plain scheduling of the groups, one at a time."""

import heapq
import zlib
from collections import Counter, defaultdict

import pytest
from tests_llm_rows import CLASHING, awkward_rows, words

from gaugeworks.llm import sharding


def plain(texts, shards):
    """Loads of scheduling each group of equal texts, the largest first."""
    groups = Counter()
    for text in texts:
        groups[text or ""] += len((text or "").encode()) + 8
    heap = [0] * shards
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return sorted(heap)


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, and a group of copies that is a third of all rows."""
    rows = [(i, t) for i, t, _, _ in awkward_rows()]
    rows += [(1000 + i, words(i % 90, 5 + i % 60)) for i in range(260)] + [(5000 + i, "the same") for i in range(150)]
    return spark.createDataFrame([r + ("v",) * (len(CLASHING) + 3) for r in rows], "doc_id long, text string, "
                                 + ", ".join(f"{c} string" for c in (*CLASHING, "shard", "slot", "size")))


def test_query(spark, folder, docs):
    out = sharding.op12_shards(spark, folder(documents=docs.repartition(3))).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, size(t), crc(t)) for i, t in texts)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    slots, load, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert set(load) <= set(range(24)) and all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # With a job a group the loads are those of scheduling group by group.
    assert sorted(load[s] for s in range(24)) == plain([t for _, t in texts], 24)


def test_small_groups_are_dealt_to_jobs(spark, docs):
    sizes = sharding.measured(docs).persist()
    total = sizes.agg({"size": "sum"}).first()[0]
    groups = Counter()
    for r in sizes.collect():
        groups[r["key"]] += r["size"]
    for jobs in (1, 8, 64):
        rows = sharding.jobs_of(sizes, jobs).collect()
        assert len(rows) <= 2 * jobs and sum(r["size"] for r in rows) == total
        alone = {r["job"]: r["size"] for r in rows if r["alone"]}
        assert alone == {k: n for k, n in groups.items() if n * jobs >= total}
        found = sharding.placed(sizes, sharding.assign(sizes, 3, jobs)).groupBy("shard").agg(
            {"size": "sum", "slot": "max", "*": "count"}).collect()
        assert all(r["max(slot)"] == r["count(1)"] - 1 for r in found)
        if jobs == 64:
            loads = [r["sum(size)"] for r in found]
            largest = max(n for n in groups.values())
            assert max(loads) - min(loads) <= max(largest, total // 64 * 3)


def test_schedule():
    jobs = [(n, False, i) for i, n in enumerate([7, 7, 6, 6, 5, 5, 4, 4, 4])]
    chosen = sharding.schedule(jobs, 3)
    load = Counter()
    for (n, *_), shard in zip(jobs, chosen):
        load[shard] += n
    # Ties go to the lower shard.
    assert chosen[:3] == [0, 1, 2] and sorted(load.values()) == plain_loads([n for n, *_ in jobs], 3)
    assert sharding.schedule([], 3) == []


def plain_loads(sizes, shards):
    loads = [0] * shards
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return sorted(loads)


def test_written_shards(spark, docs, tmp_path):
    mine = docs.drop("shard")
    sharding.write_shards(mine, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, mine.collect()))
    at = {r["text"]: r["shard"] for r in back.collect()}
    expected = sharding.shard_documents(mine, 5).join(
        mine.select("doc_id", "text").dropDuplicates(), "doc_id").select("text", "shard").distinct().collect()
    assert all(at[r["text"]] == r["shard"] for r in expected if r["text"] not in ("", None))


def test_empty(spark, docs):
    assert sharding.shard_documents(docs.limit(0)).count() == 0
