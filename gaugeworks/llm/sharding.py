"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group, which stays in one shard.  Groups are
put into jobs: a group of at least ``1 / jobs`` of all bytes is a job of its own,
the smaller ones are dealt to ``jobs`` jobs by the hash of their text.  Jobs go in
descending order of size to the least-loaded shard, which a heap gives.  However
many groups there are, there are at most ``2 * jobs`` jobs, so that the heap and
the two tables from text to shard are bounded; shards differ by about a job, a
``jobs``-th of the input, unless one group is larger than a shard's share.

A document's shard follows from its text through the tables, without a shuffle
of documents.  A document's slot is its task's own count within the shard plus
the counts of the tasks before it.

Groups are told apart by a 64-bit hash; two texts that share one stay together
as well.  A null text counts as the empty one: both have no bytes.  Repeated
rows are documents of their own in one group, null ids are kept, and an empty
table gives no rows.  Jobs of one size go by their kind and key, shards of one
load by their number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gaugeworks.llm.base import prepare, query, staged, table

SHARDS = 24

#: Jobs that small groups are dealt to; there are at most twice as many in all.
JOBS = 1 << 16

#: Bytes that a document has beside its text.
OVERHEAD = 8


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def size_of(text: Column) -> Column:
    return F.octet_length(text).cast("long") + OVERHEAD


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every document; ``key`` is its group."""
    return docs.select(
        F.col("doc_id").cast("long"), size_of(_text()).alias("size"),
        F.crc32(_text().cast("binary")).alias("text_crc32"), F.xxhash64(_text()).alias("key"))


def jobs_of(sizes: DataFrame, jobs: int = JOBS) -> DataFrame:
    """(alone, job, size) of the jobs that rows (key, size) make: a group that is
    ``alone`` has its key as ``job``, others share one."""
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = -(-total // jobs)
    groups = sizes.groupBy("key").agg(F.sum("size").alias("size"))
    alone = F.col("size") >= least
    return groups.select(
        alone.alias("alone"), F.when(alone, F.col("key")).otherwise(_shared(jobs)).alias("job"), "size",
    ).groupBy("alone", "job").agg(F.sum("size").alias("size"))


def _shared(jobs: int) -> Column:
    return F.pmod(F.col("key"), F.lit(jobs))


def schedule(jobs: list[tuple], shards: int) -> list[int]:
    """The shard of each of ``jobs``, which are tuples that begin with their size."""
    order = sorted(range(len(jobs)), key=lambda i: (-jobs[i][0], *jobs[i][1:]))
    heap, chosen = [(0, shard) for shard in range(shards)], [0] * len(jobs)
    for i in order:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + jobs[i][0], shard))
        chosen[i] = shard
    return chosen


class Assignment:
    """Shards of texts: a table for groups that are a job, one for the others'."""

    def __init__(self, alone: dict[int, int], shared: dict[int, int], jobs: int):
        keys = sorted(alone)
        self.keys = np.array(keys, np.int64)
        self.alone = np.array([alone[k] for k in keys], np.int32)
        self.shared = np.zeros(jobs, np.int32)
        for job, shard in shared.items():
            self.shared[job] = shard

    def shards(self, key: np.ndarray) -> np.ndarray:
        found = self.shared[key % len(self.shared)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.where(self.keys[at] == key, self.alone[at], found)
        return found


def assign(sizes: DataFrame, shards: int = SHARDS, jobs: int = JOBS) -> Assignment:
    """Schedule the groups of rows (key, size), which are read twice."""
    # At most 2 x ``jobs`` rows of three numbers.
    rows = [(r["size"], r["alone"], r["job"]) for r in jobs_of(sizes, jobs).collect()]
    alone, shared = {}, {}
    for (_, own, job), shard in zip(rows, schedule(rows, shards)):
        (alone if own else shared)[job] = shard
    return Assignment(alone, shared, jobs)


def placed(sizes: DataFrame, assignment: Assignment) -> DataFrame:
    """``sizes`` with each row's shard and its slot there.  The rows are staged
    with their rank within task and shard, so that slots are fixed."""
    spark = sizes.sparkSession
    held = spark.sparkContext.broadcast(assignment)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = held.value.shards(batch.column(batch.schema.get_field_index("key")).to_numpy())
            seen = np.pad(seen, (0, max(0, int(shard.max(initial=-1)) + 1 - len(seen))))
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=len(seen))
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            rank += seen[shard]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard, pa.int32()), pa.array(np.full(len(shard), task, np.int32)),
                 pa.array(rank)], [*batch.schema.names, "shard", "task", "task_rank"])

    prepare(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema.fields)
    ranked = staged(sizes.mapInArrow(run, schema + ", shard int, task int, task_rank long"), "sharded")
    # A row a shard and task, however many documents they have.
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (ranked.groupBy("shard", "task").agg(F.count("*").alias("n"))
               .select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    return ranked.join(earlier, ["shard", "task"]).select(
        *sizes.columns, "shard", (F.col("task_rank") + F.col("earlier")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, jobs: int = JOBS) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every document; texts are
    read once, and what is staged and moved has a short row a document."""
    sizes = staged(measured(docs), "sizes")
    return placed(sizes, assign(sizes, shards, jobs))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, jobs: int = JOBS) -> None:
    """Write ``docs``, all columns, as folders ``path/shard=N``.  The rebalance hint
    lets a shard be several files in several tasks."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(assign(staged(measured(docs).select("key", "size"), "sizes"), shards, jobs))

    @F.pandas_udf("int")
    def shard_of(key):
        import pandas as pd

        return pd.Series(held.value.shards(key.to_numpy()))

    prepare(spark)
    (docs.withColumn("shard", shard_of(F.xxhash64(_text()))).hint("rebalance", "shard")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


@query("op12_shards")
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
