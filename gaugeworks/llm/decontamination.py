"""Benchmark decontamination by size-partitioned MinHash containment.

An item is contained in a document when the document has at least
``containment`` of the item's distinct word shingles.  Items are dealt into
size classes by their number of shingles.  The sketch of an item is the least
hashes of its shingles, as many as its class asks for: of n shingles a
contained item lacks at most the fraction 1 - containment, so that one hash
more than that cannot all be missing.  The search for short items in long
documents thereby loses none, which banded MinHash over whole documents, whose
resemblance to a short item is near zero, cannot say.

A document looks up the hashes of all its shingles in the sketches of the
classes it is long enough for, and candidates are verified on the shingles
themselves.  Items are taken in blocks of a fixed number of sketch hashes, each
of them broadcast and searched for in one pass, so that what is broadcast is
bounded however many items there are.

Words are runs of letters, digits and underscores, lower-cased.  An item of fewer
than five words has its whole sequence as its one shingle, and is looked for among
the document's shingles of as many words; a document of fewer words than that has
its whole sequence.  Null and empty texts have none and are never contained.  Repeated items count once, repeated
documents each.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import WordTable, prepare, query, table

SHINGLE_WORDS = 5
CONTAINMENT = 0.8

#: Sketch hashes in one broadcast block.
BLOCK_HASHES = 500_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> set[str]:
    found = words(text)
    if not found:
        return set()
    return {" ".join(found[i:i + width]) for i in range(max(1, len(found) - width + 1))}


_HASHES = WordTable(lambda token: b"".join(
    xxhash.xxh64_digest(w.encode())[::-1] for w in words(token)))


def word_hashes(text: str | None) -> np.ndarray:
    """A number for each word of a text, in order."""
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, (text or "").split())), dtype="<u8")


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A number for each shingle of a text, in order."""
    return _windows(word_hashes(text), width)


def _windows(each: np.ndarray, width: int) -> np.ndarray:
    if not len(each):
        return each
    n = max(1, len(each) - width + 1)
    value = np.zeros(n, np.uint64)
    for k in range(min(width, len(each))):
        value = (value ^ each[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def size_class(n: int) -> int:
    """Class c has the items of 2**c to 2**(c + 1) - 1 shingles."""
    return n.bit_length() - 1


def sketch_size(n: int, containment: float) -> int:
    """Hashes of an item of n shingles that cannot all be missing."""
    return n - math.ceil(containment * n - 1e-9) + 1


def _sketch_rows(containment: float):
    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                each = word_hashes(text)
                distinct = np.unique(_windows(each, SHINGLE_WORDS))
                if len(distinct):
                    # The class decides: as many as its largest item would need.
                    largest = (2 << size_class(len(distinct))) - 1
                    k = min(len(distinct), sketch_size(largest, containment))
                    width = min(len(each), SHINGLE_WORDS)
                    out.append((item, text, width, len(distinct), distinct[:k].astype(np.int64)))
            columns = zip(*out) if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["item_id", "text", "width", "n", "sketch"])
    return run


class Index:
    """Sketch hashes of a block of items, by width of their shingles in size classes."""

    def __init__(self, items):
        self.items = [(r["item_id"], r["width"], shingle_set(r["text"])) for r in items]
        sizes = defaultdict(list)
        for k, r in enumerate(items):
            sizes[r["width"], size_class(r["n"])] += [(h, k) for h in r["sketch"]]
        self.classes = defaultdict(list)
        for (width, c), pairs in sorted(sizes.items()):
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], np.int64).view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            # One look in a table of the top bits rules out nearly every shingle.
            top = np.zeros(1 << 16, bool)
            top[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.classes[width].append((1 << c, hashes[order], np.array([k for _, k in pairs])[order], top))

    def candidates(self, words: np.ndarray, containment: float) -> set[int]:
        found: set[int] = set()
        for width, classes in self.classes.items():
            hashes = _windows(words, width)
            high = (hashes >> np.uint64(48)).astype(np.int64)
            for least, sorted_hashes, item, top in classes:
                if len(hashes) < math.ceil(containment * least - 1e-9):
                    continue
                some = np.unique(hashes[top[high]])
                low = np.searchsorted(sorted_hashes, some, "left")
                up = np.searchsorted(sorted_hashes, some, "right")
                for a, b in zip(low[up > low], up[up > low]):
                    found.update(item[a:b].tolist())
        return found


def _found(index: Index, text: str | None, containment: float):
    """(item, shingles, shingles found) of the items contained in a text."""
    own: dict[int, set[str]] = {}
    for k in sorted(index.candidates(word_hashes(text), containment)):
        item, width, wanted = index.items[k]
        if width not in own:
            own[width] = shingle_set(text, width)
        common = len(wanted & own[width])
        if common >= containment * len(wanted) - 1e-9:
            yield item, len(wanted), common


def indexes(items: DataFrame, containment: float = CONTAINMENT):
    """Broadcast blocks of the items (item_id, text), at least one.  A block has
    ``BLOCK_HASHES`` sketch hashes on average, by a fixed rule of the item."""
    spark = items.sparkSession
    prepare(spark)
    sketches = (items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
                .mapInArrow(_sketch_rows(containment), "item_id long, text string, width int, n int, sketch array<long>"))
    total = sketches.agg(F.sum(F.size("sketch"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_HASHES))
    for b in range(blocks):
        rows = sketches.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        yield spark.sparkContext.broadcast(Index(rows))


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, found) for every item (item_id, text)
    contained in a document (doc_id, text)."""
    def search(index):
        def run(batches):
            for batch in batches:
                out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                       for hit in _found(index.value, text, containment)]
                columns = zip(*out) if out else [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                                 ["doc_id", "item_id", "item_shingles", "found"])
        return run

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [texts.mapInArrow(search(index), "doc_id long, item_id long, item_shingles int, found int")
             for index in indexes(items, containment)]
    return reduce(DataFrame.unionByName, parts)


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, all columns as they are."""
    def clean(index):
        @F.pandas_udf("boolean")
        def free(texts: pd.Series) -> pd.Series:
            return pd.Series([next(_found(index.value, t, containment), None) is None for t in texts], dtype=bool)
        return free

    for index in indexes(items, containment):
        docs = docs.filter(clean(index)(F.col("text").cast("string")))
    return docs


@query("op5_decontamination", rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS line,
         regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (),
         regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') FROM benchmark),
widths AS (
  SELECT DISTINCT least(len(w), {SHINGLE_WORDS}) AS k FROM words WHERE side = 'i' AND len(w) > 0),
shingles AS (
  SELECT side, id, line, k, unnest(list_distinct(list_transform(
    range(1, greatest(1, len(w) - k + 1) + 1), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s
  FROM words JOIN widths ON side = 'd' OR k = least(len(w), {SHINGLE_WORDS}) WHERE len(w) > 0),
items AS (SELECT id, k, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 'i')
SELECT d.id AS doc_id, i.id AS item_id, cast(any_value(i.n) AS INTEGER) AS item_shingles,
       cast(count(*) AS INTEGER) AS found
FROM shingles d JOIN items i ON d.s = i.s AND d.k = i.k AND d.side = 'd'
GROUP BY d.id, d.line, i.id HAVING count(*) >= {CONTAINMENT} * any_value(i.n) - 1e-9
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
