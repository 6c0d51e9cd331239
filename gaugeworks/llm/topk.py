"""Exact top-k by inner product, a block of documents at a time.

Vectors lie in blocks of successive documents.  A block keeps its vectors (the
forward index) and, for every term (dimension), its largest and least value.
The sum over the terms of the larger of query weight times either is a bound on
any score in the block.  Queries are taken in groups; a task has a group of
queries and a share of the blocks, and scores blocks in the order of their
bounds until no bound of the group's reaches its k-th best score.  All queries meet
one share first, and take the k-th score they found there to the others, where a
block whose bound falls below it is not scored.  The best of the shares are merged.
How much that saves depends on the table: where vectors are of one length and lie in
no order, as embeddings may, every block's bound reaches every k-th score.

Components are whole numbers.  Vectors that are null, or hold null or a
non-finite component, take no part; empty vectors neither.  A query meets the
vectors of its own length only.  Rows that share a query's id are its own; other
repeated rows each count, and a repeated query is asked once.  Queries of one id
and several vectors share one ranking, of the best that any of them finds.  Ties go to the
smaller id.  A null id is no query and no candidate.  Scores beyond 64 bits are
held at the limit.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugeworks.llm.base import prepare, query, staged, table

#: Vectors of a block, queries of a group, and blocks of a share.
BLOCK_ROWS, GROUP_QUERIES, SHARE_BLOCKS = 512, 1024, 16

_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, parts) with parts = floor(scale * component)."""
    parts = F.col("embedding").cast("array<double>")
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), parts.alias("parts"), sound.alias("sound"))
            .filter("vec_id IS NOT NULL AND sound AND size(parts) > 0")
            .select("vec_id", F.transform("parts", lambda x: F.floor(x * scale)).alias("parts")))


def _matrix(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by length."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    return {int(n): (ids[sizes == n], flat[starts[sizes == n][:, None] + np.arange(n)])
            for n in np.unique(sizes)}


def _packed(rows: int):
    """Batches to rows of up to ``rows`` vectors of one length."""
    def run(batches):
        for batch in batches:
            out = []
            for n, (ids, x) in _matrix(batch).items():
                for at in range(0, len(ids), rows):
                    out.append((n, ids[at:at + rows].tobytes(), x[at:at + rows].tobytes()))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))],
                ["length", "ids", "x"])
    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q times x transposed: in doubles where every sum is exact, else in whole
    numbers of any size, held at 64 bits."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0))
    if most * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), _LOW, _HIGH).astype(np.int64)


def _bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """At least the largest product of each query with any row of x."""
    high, low = x.max(0).astype(float), x.min(0).astype(float)
    positive = q.astype(float)
    bound = np.maximum(positive, 0) @ high + np.minimum(positive, 0) @ low
    return bound + np.abs(bound) * 1e-9


def _nearest(qid: np.ndarray, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int,
             floor: np.ndarray | None = None):
    """(query, candidate, score) of the k best of some blocks for each query, of those
    that reach its ``floor``."""
    floor = np.full(len(q), _LOW, np.int64) if floor is None else floor
    bounds = np.stack([_bounds(q, x) for _, x in held])
    order = np.argsort(-bounds, axis=0, kind="stable")
    top = np.full((len(q), k), _LOW, np.int64)  # best scores so far, of ``full`` candidates
    who = np.zeros((len(q), k), np.int64)
    full = np.zeros(len(q), np.int64)
    for at in order:  # each query's next block
        least = np.maximum(floor, np.where(full < k, _LOW, top[:, -1]))
        live = np.flatnonzero(bounds[at, np.arange(len(q))] >= least.astype(float))
        if not len(live):
            break
        for b in np.unique(at[live]):
            rows = live[at[live] == b]
            ids, x = held[b]
            for scores, row in zip(_products(q[rows], x), rows):
                least = max(floor[row], top[row, -1] if full[row] == k else _LOW)
                some = np.flatnonzero((ids != qid[row]) & (scores >= least))
                if len(some) > 4 * k:  # ties with the k-th stay
                    some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
                s = np.r_[top[row, :full[row]], scores[some]]
                i = np.r_[who[row, :full[row]], ids[some]]
                best = np.lexsort((i, -s))[:k]
                full[row] = len(best)
                top[row, :len(best)], who[row, :len(best)] = s[best], i[best]
    filled = np.arange(k) < full[:, None]
    return np.repeat(qid, full), who[filled], top[filled]


def _search(k: int):
    def run(key, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = [[np.zeros(0, np.int64)] * 3]
        sizes = queries["parts"].map(len) if len(queries) else []
        for n in sorted(set(blocks["length"]) & set(sizes)):
            asked, own = queries[sizes == n], blocks[blocks["length"] == n]
            held = [(np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, n))
                    for i, x in zip(own["ids"], own["x"])]
            floor = asked["floor"].to_numpy(np.int64)
            found.append(_nearest(asked["vec_id"].to_numpy(np.int64), np.stack(asked["parts"]), held, k, floor))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))
    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best of ``vectors``,
    both (vec_id, parts).  Every group of queries meets every share of the
    blocks; groups and shares have a fixed size, and follow from counts."""
    prepare(vectors.sparkSession)
    # Blocks are stretches of the table as it is read: no shuffle, and even in
    # size whatever the ids are.
    blocks = staged(vectors.select("vec_id", "parts").mapInArrow(
        _packed(BLOCK_ROWS), "length int, ids binary, x binary"), "blocks")
    asked = queries.select("vec_id", "parts").dropDuplicates(["vec_id", "parts"])
    shares = max(1, -(-blocks.count() // SHARE_BLOCKS))
    teams = max(1, -(-queries.count() // GROUP_QUERIES))

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = asked.withColumn("team", F.pmod(F.xxhash64("vec_id", "parts"), F.lit(teams)).cast("int"))
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(sent, some):
        some = some.withColumn("team", all_of(teams))
        return (sent.groupBy("team", "share").cogroup(some.groupBy("team", "share"))
                .applyInPandas(_search(k), "query_id long, vec_id long, score long"))

    first = asked.withColumn("floor", F.lit(_LOW)).withColumn("share", F.lit(0))
    near = staged(search(first, dealt.filter("share = 0")), "nearest")
    if shares > 1:
        floors = (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
                  .select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")))
        rest = (asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW)))
                .withColumn("share", F.explode(F.sequence(F.lit(1), F.lit(shares - 1)))))
        near = near.unionByName(search(rest, dealt.filter("share > 0")))
    return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op1_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score FROM s
QUALIFY rank <= 10
""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)
