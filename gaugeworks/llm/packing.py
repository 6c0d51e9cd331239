"""Best-fit packing of tokenized documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths).  What a piece takes of each follows from its length
alone, so that pieces of a length are alike: the choice of sequences is made
for the histogram of lengths, which has at most ``tokens`` rows however many
documents there are, and every piece then finds its place by its rank among
the pieces of its length.

Texts are tokenized once, in the tasks that read them; later steps move a
short row a piece.  Ranks are a task's own count plus the counts of the tasks
before it, so that no task sees all pieces of a frequent length.

Null and empty texts have the end token alone and are packed like any other.
A repeated row is a document of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugeworks.llm.base import prepare, query, staged, table


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024


#: First byte of UTF-8 from U+0240 on.  Below it the rank file and the
#: tokenizer file split texts alike; other texts take the slower library.
_PLAIN_BELOW = 0xC9


class Encoder:
    """Ids of byte-level BPE, as the tokenizer file gives them.

    The rank file holds the same vocabulary and is about three times as fast.
    A text that names a special token, or has letters beyond the Latin ones,
    goes through the tokenizer file itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(tokenizer_file)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < _PLAIN_BELOW:
            if not any(s in text for s in self.specials):
                return self.ranks.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def encoder(*files: str) -> Encoder:
    """The worker's encoder, loaded once."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def public_files() -> tuple[str, str, str]:
    """Tokenizer file, rank file and split pattern of the public vocabulary."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cuts(n: int, tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first are full."""
    first = n if n <= tokens else n % tokens or tokens
    return [(0, first)] + [(at, tokens) for at in range(first, n, tokens)]


_PIECE = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "task int, task_rank long")


def pieces(docs: DataFrame, files: tuple[str, str, str], tokens: int = 1024, end_id: int = 2,
           keep_ids: bool = False) -> DataFrame:
    """One row per piece, with its rank among the task's pieces of its length.

    ``keep_ids`` adds the piece's ids, for :func:`sequences`.
    """
    schema = _PIECE + (", ids array<int>" if keep_ids else "")

    def run(batches):
        codes, seen, task = encoder(*files), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*codes.ids(text or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), tokens)):
                    part = ids[start:start + length]
                    row = (doc_id, k, start, length, zlib.crc32(part), task, seen[length])
                    out.append(row + (part.astype(np.int32),) if keep_ids else row)
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                     pa.list_(pa.int32())]
            names = [c.split()[0] for c in schema.split(", ")]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Where the pieces of each length go.

    Row i places the ``rank``-th to next row's ``rank``-th piece of ``length``,
    ``each`` to a sequence from ``sequence`` on, from ``offset`` in it.
    """

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.rank
        row = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        nth = rank - self.rank[row]
        return self.sequence[row] + nth // self.each[row], self.offset[row] + nth % self.each[row] * length


def best_fit(histogram: dict[int, int], capacity: Capacity, choose: str = "norm",
             weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Plan:
    """Vector best-fit of piece lengths, long ones first.

    Sequences with one and the same filling form a class.  The pieces of a
    length go to the class that ``choose`` prefers among those that hold one
    more under every capacity: ``norm`` takes the least weighted norm of what
    would remain, ``dot`` the largest weighted dot-product of what the piece
    takes and what is left.  A sequence takes as many as fit.  Where no class
    has room a new one is opened.  A piece that alone exceeds the document or
    cost capacity gets a sequence of its own.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.cost], dtype=np.int64)
    weight = np.array(weights)
    room = np.zeros((0, 3), np.int64)  # what is left of each class
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)  # its sequences
    rows, opened = [], 0

    def fits(left, length):
        return int(min(left[0] // length, left[1], left[2] // (length * length)))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        while count:
            open_ = np.flatnonzero((room >= need).all(1))
            if len(open_):
                left = (room[open_] - need) / full
                score = (-(weight * left * left).sum(1) if choose == "norm"
                         else (weight * (need / full) * (room[open_] / full)).sum(1))
                at = open_[np.argmax(score)]
                each = fits(room[at], length)
            else:  # as many new sequences as this length can fill
                each = max(1, fits(full, length))
                room = np.vstack([room, full[None]])
                first, many = np.append(first, opened), np.append(many, -(-count // each))
                opened += int(many[-1])
                at = len(room) - 1
            begin, left, offset = int(first[at]), room[at].copy(), int(full[0] - room[at][0])
            whole = min(int(many[at]), count // each)
            parts = [(each, whole)] if whole else []
            if whole < many[at] and count % each:
                parts.append((count % each, 1))
            for take, bins in parts:
                rows.append((length, rank, take, begin, offset))
                rank, count = rank + take * bins, count - take * bins
                room = np.vstack([room, (left - take * need)[None]])
                first, many = np.append(first, begin), np.append(many, bins)
                begin += bins
                first[at], many[at] = begin, many[at] - bins
            keep = (many > 0) & (room[:, 0] > 0) & (room[:, 1] > 0)
            room, first, many = room[keep], first[keep], many[keep]
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=opened)


def pack(placed: DataFrame, capacity: Capacity = Capacity(), choose: str = "norm",
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Give every row of a staged :func:`pieces` table its sequence and offset."""
    spark = placed.sparkSession
    # At most ``capacity.tokens`` rows, and a plan of as many classes.
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit(counts, capacity, choose, weights))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (placed.groupBy("length", "task").agg(F.count("*").alias("n"))
               .select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sequence, offset = plan.value.place(
                column["length"].to_numpy(),
                column.pop("task_rank").to_numpy() + column.pop("earlier").to_numpy())
            column |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    ranked = placed.join(earlier, ["length", "task"]).drop("task")
    names = [f for f in placed.schema.fields if f.name not in ("task", "task_rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    return (ranked.select(*(f.name for f in names), "task_rank", "earlier")
            .mapInArrow(run, schema + ", sequence_id long, offset long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from pieces packed with their ids.

    A group is one sequence, which the token capacity bounds.
    """
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, files: tuple[str, str, str] | None = None,
                   capacity: Capacity = Capacity(), end_id: int = 2) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack them; the piece table is staged."""
    made = pieces(docs, files or public_files(), capacity.tokens, end_id)
    return pack(staged(made, "pieces"), capacity)


@query("op3_pack")
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
