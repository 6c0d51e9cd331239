"""Vector code compression: codebooks for parts of vectors, by Lloyd's rounds over
cover trees.

Components become whole numbers, and vectors are cut into equal parts, each with
a codebook of its own.  A task cuts its rows into blocks and builds a cover tree
over every part of a block: a node covers the points within its radius, its
children are centers more than half that radius apart, the points of a subtree
lie together, and cumulative sums give the sum of any subtree.  Blocks with their
trees are written once and serve all rounds.

In a round a node's center is compared with the entries.  Where the second
nearest is farther than the nearest by more than twice the radius, every point
below has the same nearest entry by the triangle inequality, and the subtree's sum
and count go there whole.  Only other nodes descend, and only the points of
ambiguous leaves are compared.  Distances are exact whole numbers; the test on
their roots leaves room for rounding.  A task sends one sum an entry.

Vectors that are null, empty, or hold null or non-finite components take no part,
nor do those whose length is no multiple of the number of parts, whose length is
not that of the least vector id's, or whose components are so large that a squared
error would not fit 64 bits (beyond 32,768 at 64 components).  Codebooks begin with
the least vector ids, a null one last; of rows that share an id the least vector
counts.  Fewer ids give fewer entries.  Repeated rows have a code each.  Ties go to
the lower entry.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import prepare, query, staged, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Rows of a block.  A task holds the blocks of what it reads, one at a time works.
BLOCK_ROWS = 4096

#: Points below which a node is not cut further.
LEAF_POINTS = 16


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, points by entries."""
    apart = points[:, None, :].astype(np.int64) - entries[None]
    return np.einsum("ijk,ijk->ij", apart, apart)


@dataclass
class Tree:
    """A cover tree.  Arrays of points are in the order of the leaves; a node has the
    points ``low`` to ``high`` and the children ``first`` to ``last``."""

    points: np.ndarray
    weight: np.ndarray  # rows that have the point
    sums: np.ndarray  # of weighted points before each
    counts: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray  # place of each row's point

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF_POINTS) -> Tree:
        points, row, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        order = np.arange(len(points))
        away = distances(points, points[:1])[:, 0]
        nodes = [[0, float(np.sqrt(away.max())), 0, len(points), 0, 0]]
        for node in nodes:  # grows while it is walked
            center, radius, low, high = node[:4]
            node[4] = node[5] = len(nodes)
            if high - low <= leaf or radius == 0:
                continue
            mine = order[low:high].copy()
            child, centers, reach = _cover(points[mine], int(np.flatnonzero(mine == center)[0]), radius / 2)
            order[low:high] = mine[np.argsort(child, kind="stable")]
            sizes = np.bincount(child)
            for at, size, far in zip(centers, sizes, reach):
                nodes.append([int(mine[at]), far, low, low + int(size), 0, 0])
                low += int(size)
            node[5] = len(nodes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        center, radius, low, high, first, last = map(np.array, zip(*nodes))
        points, weight = points[order], weight[order]
        before = lambda values: np.concatenate((np.zeros_like(values[:1]), np.cumsum(values, axis=0)))
        return cls(points.astype(np.int32), weight, before(points * weight[:, None]), before(weight),
                   place[center], radius.astype(float), low, high, first, last, place[row.ravel()])

    def descend(self, entries: np.ndarray):
        """(decided nodes, their entries, single points, their entries)."""
        nodes, decided, singles = np.zeros(1, np.int64), [], []
        while len(nodes):
            apart = distances(self.points[self.center[nodes]], entries)
            nearest = apart.argmin(1)
            d1 = np.sqrt(apart.min(1))
            apart[np.arange(len(nodes)), nearest] = np.iinfo(np.int64).max
            gap = np.sqrt(apart.min(1)) * (1 - 1e-12) - d1 * (1 + 1e-12)
            radius = self.radius[nodes]
            whole = (radius == 0) | (gap > 2 * radius * (1 + 1e-12)) | (len(entries) == 1)
            decided.append((nodes[whole], nearest[whole]))
            nodes = nodes[~whole]
            leaf = self.first[nodes] == self.last[nodes]
            some = _ranges(self.low[nodes[leaf]], self.high[nodes[leaf]])
            singles.append((some, distances(self.points[some], entries).argmin(1)))
            nodes = _ranges(self.first[nodes[~leaf]], self.last[nodes[~leaf]])
        return *map(np.concatenate, zip(*decided)), *map(np.concatenate, zip(*singles))

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the rows nearest to each entry."""
        nodes, whole, singles, own = self.descend(entries)
        count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        low, high = self.low[nodes], self.high[nodes]
        np.add.at(count, whole, self.counts[high] - self.counts[low])
        np.add.at(total, whole, self.sums[high] - self.sums[low])
        np.add.at(count, own, self.weight[singles])
        np.add.at(total, own, self.points[singles] * self.weight[singles, None])
        return count, total

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row."""
        nodes, whole, singles, own = self.descend(entries)
        entry = np.empty(len(self.points), np.int64)
        low, high = self.low[nodes], self.high[nodes]
        entry[_ranges(low, high)] = np.repeat(whole, high - low)
        entry[singles] = own
        apart = self.points.astype(np.int64) - entries[entry]
        return entry[self.row], (apart * apart).sum(1)[self.row]


def _cover(points: np.ndarray, center: int, radius: float):
    """(child of each point, centers, the children's radii): ``center`` is the first
    child's, and the next is a point that no child's ``radius`` covers yet."""
    child, away = np.zeros(len(points), np.int64), np.zeros(len(points))
    rest, centers = np.arange(len(points)), []
    while len(rest):
        centers.append(center)
        far = np.sqrt(distances(points[rest], points[center:center + 1])[:, 0])
        near = far <= radius
        child[rest[near]], away[rest[near]] = len(centers) - 1, far[near]
        rest = rest[~near]
        center = int(rest[0]) if len(rest) else -1
    reach = np.zeros(len(centers))
    np.maximum.at(reach, child, away)
    return child, centers, reach.tolist()


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to its high."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the vectors that take part, whatever their length."""
    size = F.size("e")
    most = F.floor(F.sqrt(F.lit(float(1 << 60)) / size))
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= most))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                           F.col("embedding").cast("array<double>").alias("e"))
            .filter(F.col("e").isNotNull() & (size > 0) & (size % parts == 0) & usable)
            .select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("x")))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """A codebook a part, from the least ids; none where no vector is left."""
    in_order = F.col("vec_id").asc_nulls_last()
    least = kept.orderBy(in_order, "x").select(F.size("x").alias("n")).first()
    if least is None:
        return []
    same = kept.filter(F.size("x") == least["n"])
    # ``entries`` ids, then a vector each.
    ids = [r["vec_id"] for r in same.select("vec_id").distinct().orderBy(in_order).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    named = F.coalesce(named, F.lit(None in ids))
    rows = same.filter(named).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(in_order).collect()
    start = np.array([r["x"] for r in rows], np.int64)
    return list(start.reshape(len(start), parts, -1).transpose(1, 0, 2))


def blocks(kept: DataFrame, width: int, parts: int, rows: int = BLOCK_ROWS, leaf: int = LEAF_POINTS) -> DataFrame:
    """One row a block: its ids, labels, and the trees of its parts."""
    names = ["ids", "labels", "trees"]

    def block(ids, labels, x):
        trees = [Tree.build(part, leaf) for part in np.split(x, parts, axis=1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
             pa.array([pickle.dumps(trees)], pa.binary())], names)

    def run(batches):
        ids, labels, xs = [], [], []
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, width)
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            xs.append(x)
            if len(ids) >= rows:
                whole = np.concatenate(xs)
                while len(ids) >= rows:
                    yield block(ids[:rows], labels[:rows], whole[:rows])
                    ids, labels, whole = ids[rows:], labels[rows:], whole[rows:]
                xs = [whole]
        if ids:
            yield block(ids, labels, np.concatenate(xs))

    prepare(kept.sparkSession)
    return kept.filter(F.size("x") == width).select("vec_id", "label", "x").mapInArrow(
        run, "ids array<long>, labels array<string>, trees binary")


def next_codebooks(made: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the mean of the parts nearest to it, rounded down."""
    held = made.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        found = [(np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)) for c in held.value]
        for batch in batches:
            for raw in batch.column(0):
                for tree, entries, (count, total) in zip(pickle.loads(raw.as_py()), held.value, found):
                    n, s = tree.totals(entries)
                    count += n
                    total += s
        rows = [(p, e, k, v) for p, (count, total) in enumerate(found) for e in range(len(count)) if count[e]
                for k, v in enumerate([int(count[e]), *total[e].tolist()], -1)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["part", "entry", "place", "value"])

    rows = (made.select("trees").mapInArrow(run, "part int, entry int, place int, value long")
            .groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect())
    got = {(r["part"], r["entry"], r["place"]): r["value"] for r in rows}
    return [np.array([[got[p, e, k] // got[p, e, -1] for k in range(len(old))] if (p, e, -1) in got else old.tolist()
                      for e, old in enumerate(entries)], np.int64)
            for p, entries in enumerate(codebooks)]


def coded(made: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row of ``made``."""
    held = made.sparkSession.sparkContext.broadcast(codebooks)
    digits = np.array([f"{i:02x}" for i in range(256)], object)

    def run(batches):
        for batch in batches:
            for ids, labels, raw in zip(*batch.columns):
                got = [tree.assigned(c) for tree, c in zip(pickle.loads(raw.as_py()), held.value)]
                codes = sum((digits[entry] for entry, _ in got[1:]), digits[got[0][0]])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(codes.tolist(), pa.string()),
                     pa.array(sum(error for _, error in got))], ["vec_id", "label", "code", "error"])

    return made.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(codebooks: list[np.ndarray]) -> str:
    numbers = ",".join(str(n) for entries in codebooks for n in entries.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the vectors (vec_id, label, embedding) that
    take part, staged, and the codebooks: ``entries`` whole-number rows a part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    kept = whole_numbers(vectors, parts, scale)
    codebooks = first_codebooks(kept, parts, entries)
    width = parts * codebooks[0].shape[1] if codebooks else parts
    made = staged(blocks(kept, width, parts), "trees")
    for _ in range(rounds if codebooks else 0):
        codebooks = next_codebooks(made, codebooks)
    return staged(coded(made, codebooks), "codes"), codebooks


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out one below the other."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding,
    lambda x: cast(floor({scale} * cast(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT r, vec_id, label, g.p, len(x) // {parts} AS w,
    x[g.p * (len(x) // {parts}) + 1 : (g.p + 1) * (len(x) // {parts})] AS x
  FROM v, range({parts}) AS g(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM p
  QUALIFY e < {entries})"""]
    near = """a{0} AS MATERIALIZED (SELECT r, p.p, min(struct_pack(d := cast(list_sum(list_transform(
    range(1, w + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT), e := b.e)) AS m
  FROM p JOIN b{0} b ON p.p = b.p GROUP BY r, p.p)"""
    for k in range(rounds):
        steps.append(near.format(k))
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
  SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT a.p, a.m.e AS e, i,
      cast(floor(sum(p.x[i]) / count(*)) AS BIGINT) AS m
    FROM a{k} a JOIN p ON a.r = p.r AND a.p = p.p, unnest(range(1, p.w + 1)) AS g(i) GROUP BY ALL)
  GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    steps.append(near.format(rounds))
    steps.append(f"""c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code,
    cast(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN v ON c.r = v.r"""


@query("op11_vector_codes", _oracle())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    errors = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(errors, codes["label"].eqNullSafe(errors["of"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
