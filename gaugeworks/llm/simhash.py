"""SimHash near-duplicates, found with pivot distance tables.

A text's fingerprint has a bit for each bit position of its shingles' hashes.
Texts with one fingerprint are linked by grouping; different fingerprints are
linked when they differ in at most ``radius`` bits.  The 64 bits are cut into
``radius + 2`` blocks.  Two linked fingerprints agree on at least two blocks,
so that comparing within the groups that share two blocks loses no link.

Within a group the distances of all fingerprints to a fixed set of pivots are
tabled.  By the triangle inequality a linked pair differs by at most
``radius`` in every coordinate; other pairs are discarded by their largest
coordinate difference, and the survivors are verified.  A group gives the edges
of a spanning forest rather than all its pairs: components are the same.

Null and empty texts have fingerprint zero, which links like any other.  A
repeated row repeats its result.  A null id takes no part in the least id, and
a component of null ids alone has a null one.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import prepare, query, staged, table
from gaugeworks.llm.components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42

#: Fingerprints of a group that one task compares; larger groups are cut into
#: chunks of this size and compared chunk by chunk.
GROUP_ROWS = 20_000

#: Rows that a task looks at together.
_SLAB_ROWS = 65_536

#: Reference fingerprints, by rule.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(16)], np.uint64)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> list[bytes]:
    """Shingles of a text, A-Z lower-cased, repeats included.  A text of fewer
    words has its whole sequence as the only one, a text of none has none."""
    tokens = (text or "").encode().lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens]).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64 bits as a signed number."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles(text, words)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # a very long text in parts
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of every document."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")) \
        .mapInArrow(run, "doc_id long, text_hash long, fp long")


def _pairs_within(fp: np.ndarray, key: np.ndarray, lags: int, radius: int):
    """Linked pairs of rows at most ``lags`` apart with the same key."""
    near = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    for lag in range(1, min(lags, len(fp) - 1) + 1):
        at = np.flatnonzero(key[lag:] == key[:-lag])
        at = at[np.abs(near[at + lag] - near[at]).max(1, initial=0) <= radius]
        at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        yield fp[at], fp[at + lag]


def _forest(fp: np.ndarray, radius: int):
    """Edges that connect what is linked among ``fp``: each fingerprint is met
    once and compared with those not met before."""
    near = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    order = np.argsort(near[:, 0], kind="stable")
    fp, near = fp[order], near[order]
    rest = np.arange(len(fp))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            low, high = np.searchsorted(near[rest, 0], (near[x, 0] - radius, near[x, 0] + radius + 1))
            some = rest[low:high]
            some = some[np.abs(near[some] - near[x]).max(1, initial=0) <= radius]
            some = some[np.bitwise_count(fp[some] ^ fp[x]) <= radius]
            if len(some):
                yield np.repeat(fp[x], len(some)), fp[some]
                todo.extend(some.tolist())
                rest = np.setdiff1d(rest, some, assume_unique=True)


def _links(batches, radius: int, small: int = 8):
    """Edges of batches sorted by key, a slab of whole groups at a time."""
    def solve(key, fp):
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        mine = np.repeat((sizes > 1) & (sizes <= small), sizes)
        pairs = list(_pairs_within(fp[mine], key[mine], small - 1, radius)) if mine.any() else []
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            pairs += _forest(np.unique(fp[s:s + n]), radius)
        if pairs:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys, fps, held = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy().view(np.uint64))
        held += len(keys[-1])
        if held >= _SLAB_ROWS:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            yield from solve(key[:cut], fp[:cut])
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
    if keys:
        yield from solve(np.concatenate(keys), np.concatenate(fps))


def _block_keys(fp, radius: int):
    """One key for every two of the blocks of ``fp``, as an array column."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
             for lo, hi in zip(edges, edges[1:])]
    return F.array(*(
        F.xxhash64(F.lit(k), parts[i], parts[j]) for k, (i, j) in enumerate(combinations(range(blocks), 2))))


def links(distinct: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of ``distinct`` (fp)."""
    keyed = distinct.select(F.explode(_block_keys(F.col("fp"), radius)).alias("key"), "fp")
    crowded = (keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
               .select("key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1)))
                      .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = (keyed.join(crowded, "key", "left").withColumn("own", own).withColumn("other", other)
             .select(F.when(F.col("other") < 0, F.col("key"))
                     .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
                     .alias("key"), "fp"))
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda batches: _links(batches, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of every document (doc_id, text);
    root is the component's least fingerprint."""
    marked = staged(fingerprints(docs, words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = nodes.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("reached"))
    named = nodes.join(linked, "root", "left").select(
        "fp", F.coalesce("reached", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, found: DataFrame, group) -> DataFrame:
    """One row of each group of ``found`` (doc_id, text_hash and what ``group``
    needs): null ids come last, of rows alike in id and text any one stays."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("best")
    kept = found.groupBy(group.alias("g")).agg(best).select(
        F.col("best.doc_id").alias("k_id"), F.col("best.text_hash").alias("k_hash"))
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("k_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("k_hash"))
    return (held.join(kept.distinct(), held["k_id"].eqNullSafe(kept["k_id"]) & (held["k_hash"] == kept["k_hash"]),
                      "left_semi")
            .dropDuplicates(["k_id", "k_hash"]).select("doc.*"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the least id, and of rows that
    share it the one with the least text hash.  A component without ids keeps
    its least text hash; of rows alike in both any one stays."""
    found = near_duplicates(docs, words, radius)
    return one_of_each(docs, found, F.col("root"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
