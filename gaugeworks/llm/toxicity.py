"""Toxicity by nearest labelled examples.

Terms are words, and all words of a bounded sample of labelled documents count; how
many documents have each is counted over all documents.  A text's vector is its
TF-IDF weights, each times the root of the word's association with the labels, as
IDF alone lets rare words without meaning choose the neighbours.  Neighbours are the
examples of largest cosine, found exactly: examples lie in blocks, each word has
its largest weight per block, and blocks are scored in order of their bound until no
bound reaches the worst neighbour.  Votes are weighted by cosine and turned into a
probability by a monotone fit over the examples, each scored by the others.

A score depends on the text alone.  A text without any of the words, null and
empty ones included, has the share of toxic documents among examples without
words.  Ties between neighbours go to the example that comes first.  A repeated
row repeats its score.  An id that is labelled both ways counts as toxic; of texts
that share an id the one of least hash is learned from.  Where no word goes with a
label, IDF alone weighs.  Without labelled documents of both classes every score
is the share of toxic labels, or 0 without labels.  An empty table gives none.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import WordTable, digit, prepare, query, release, share, staged, table

#: Labelled examples drawn of each class (their expected number), the neighbours
#: that vote, and the examples of a block.
EXAMPLES, NEIGHBOURS, BLOCK = 2000, 15, 64

#: Tokens whose word a worker remembers; it may hold two such tables.
KNOWN_TOKENS = 80_000

#: Share of the examples from which on a term is common, and texts that are looked
#: up together.
COMMON, TEXTS = 1 / 16, 64

#: Blocks that are scored together: few at first, then all that may still matter.
_STEPS = (8,)

_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def term_of(token: str) -> str:
    """The word in a token; nothing where there is none."""
    return token.strip(_STRIP).lower()


def _class_counts(batches):
    """Documents of the task's examples that have each term, by class."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in {term_of(token) for token in set((text or "").split())} - {""}:
                seen.setdefault(term, [0, 0])[toxic] += 1
    for at in range(0, len(names := list(seen)), 10_000):
        part = names[at:at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), *(pa.array([seen[t][c] for t in part], pa.int64()) for c in (0, 1))],
            ["term", "clean", "toxic"])


def association(counts: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The G-squared statistic of each term against the classes; ``counts`` has the
    clean and the toxic examples with the term."""
    counts, size = counts.astype(float), np.array(sizes, float)
    has, total = counts.sum(1, keepdims=True), size.sum()
    out = np.zeros(len(counts))
    for observed, expected in ((counts, has * size / total), (size - counts, (total - has) * size / total)):
        ratio = np.divide(observed, expected, out=np.ones_like(observed), where=observed > 0)
        out += 2 * (observed * np.log(ratio)).sum(1)
    return np.maximum(out, 0)


class Vectors:
    """Term counts of a text over a fixed list of terms."""

    def __init__(self, terms: tuple[str, ...]):
        self.terms = terms
        self.place = {t: i for i, t in enumerate(terms)}
        self.table = WordTable(self._id, KNOWN_TOKENS)

    def __reduce__(self):
        return Vectors, (self.terms,)

    def _id(self, token: str) -> bytes:
        at = self.place.get(term_of(token))
        return b"" if at is None else array("i", [at]).tobytes()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(map(self.table.__getitem__, (text or "").split())), np.intc)
        return np.unique(ids, return_counts=True)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to its high."""
    size = high - low
    return np.arange(size.sum(), dtype=np.int32) + np.repeat((low - (np.cumsum(size) - size)).astype(np.int32), size)


@dataclass
class Index:
    """Examples as an inverted index.  Postings are by term, then example; those of
    one term in one block are an entry with their largest weight.  Terms that one
    example in ``1 / COMMON`` or more has are columns of a table instead, whose part
    of every cosine a matrix product gives for many texts together."""

    idf: np.ndarray
    label: np.ndarray
    key: list
    column: np.ndarray  # a common term's column, -1 for others
    table: np.ndarray  # common terms x examples, whole blocks
    example: np.ndarray
    weight: np.ndarray
    starts: np.ndarray  # a term's first entry
    block: np.ndarray
    largest: np.ndarray
    low: np.ndarray  # an entry's first posting, and how many there are
    size: np.ndarray
    blocks: int

    @classmethod
    def build(cls, idf, examples, block=BLOCK):
        """``examples``: (key, label, ids, counts) with one id at least."""
        term = np.concatenate([e[2] for e in examples]).astype(np.int64)
        example = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
        weight = np.concatenate([cls._weights(idf, e[2], e[3]) for e in examples])
        blocks = -(-len(examples) // block)
        common = np.bincount(term, minlength=len(idf)) >= COMMON * len(examples)
        column = np.where(common, np.cumsum(common) - 1, -1)
        table = np.zeros((int(common.sum()), blocks * block))
        often = common[term]
        table[column[term[often]], example[often]] = weight[often]
        order = np.lexsort((example[~often], term[~often]))
        term, example, weight = term[~often][order], example[~often][order], weight[~often][order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (example[1:] // block != example[:-1] // block)
        low = np.flatnonzero(new)
        return cls(idf, np.array([e[1] for e in examples], np.int8), [e[0] for e in examples], column, table,
                   example.astype(np.int32), weight, np.searchsorted(term[low], np.arange(len(idf) + 1)).astype(np.int32),
                   (example[low] // block).astype(np.int32), np.maximum.reduceat(weight, low) if len(low) else weight,
                   low.astype(np.int32), np.diff(np.append(low, len(term))).astype(np.int32), blocks)

    @staticmethod
    def _weights(idf, ids, counts):
        w = (1 + np.log(counts)) * idf[ids]
        return w / (math.sqrt((w * w).sum()) or 1)

    def weights(self, ids, counts):
        return self._weights(self.idf, ids, counts)

    def nearest(self, texts, k=NEIGHBOURS, but=None, seen=None):
        """For each text (ids, counts) its k nearest examples with a positive cosine,
        as (example, cosine), best first; ``but`` names an example to leave out for
        each.  ``seen`` takes the numbers of the blocks that are scored."""
        for at in range(0, len(texts), TEXTS):
            part = [(ids, self.weights(ids, counts)) for ids, counts in texts[at:at + TEXTS]]
            asked = np.zeros((len(part), len(self.table)))
            for row, (ids, w) in zip(asked, part):
                column = self.column[ids]
                row[column[column >= 0]] = w[column >= 0]
            often = asked @ self.table
            best_often = often.reshape(len(part), self.blocks, -1).max(2)
            for j, (ids, w) in enumerate(part):
                left_out = -1 if but is None else but[at + j]
                yield self._nearest(ids, w, often[j], best_often[j], k, left_out, seen)

    def _nearest(self, ids, w, often, best_often, k, but, seen):
        first, last = self.starts[ids], self.starts[ids + 1]
        entry, mine = _ranges(first, last), np.repeat(w, last - first)
        block = self.block[entry]
        bound = np.bincount(block, mine * self.largest[entry], self.blocks) + best_often
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        who, cosine, done, each = np.zeros(0, np.int64), np.zeros(0), 0, len(often) // self.blocks
        for step in (*_STEPS, len(order)):
            chosen = order[done:done + step]
            if len(who) == k:
                chosen = chosen[bound[chosen] >= cosine[-1] - 1e-12]
            if not len(chosen):
                break
            done += step
            wanted = np.zeros(self.blocks, bool)
            wanted[chosen] = True
            some = np.flatnonzero(wanted[block])
            entries = entry[some]
            low, size = self.low[entries], self.size[entries]
            at = _ranges(low, low + size)
            found = np.bincount(self.example[at], np.repeat(mine[some], size) * self.weight[at], len(often))
            found = found + often
            if but >= 0:
                found[but] = 0
            chosen = np.sort(chosen)
            theirs = found.reshape(self.blocks, each)[chosen].ravel()
            least = cosine[-1] if len(who) == k else 0.0
            if len(theirs) > k:
                least = max(least, np.partition(theirs, -k)[-k])
            new = np.flatnonzero((theirs > 1e-12) & (theirs >= least - 1e-11))
            who = np.concatenate((who, chosen[new // each] * each + new % each))
            cosine = np.concatenate((cosine, np.round(theirs[new], 12)))
            best = np.lexsort((who, -cosine))[:k]
            who, cosine = who[best], cosine[best]
            if seen is not None:
                seen.extend(chosen.tolist())
        return list(zip(who.tolist(), cosine.tolist()))

    def votes(self, texts, but=None):
        """For each text the share of the cosine that toxic neighbours have, nothing
        where there are none, and the neighbours."""
        for near in self.nearest(texts, but=but):
            total = sum(c for _, c in near)
            yield (round(sum(c for i, c in near if self.label[i]) / total, 9) if total else None), near


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Steps (from, value) of the weighted monotone fit of y on x."""
    blocks: list[list[float]] = []  # from, value, weight
    places, at = np.unique(x, return_inverse=True)
    weights = np.bincount(at, w)
    for start, value, weight in zip(places.tolist(), (np.bincount(at, w * y) / weights).tolist(), weights.tolist()):
        blocks.append([start, value, weight])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, v, n = blocks.pop()
            start, u, m = blocks.pop()
            blocks.append([start, (u * m + v * n) / (m + n), m + n])
    return [b[0] for b in blocks], [b[1] for b in blocks]


@dataclass
class Model:
    vectors: Vectors
    index: Index | None
    base: float  # of texts without terms or neighbours
    steps: tuple[list[float], list[float]] = ((), ())

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list]]:
        """Score and neighbours of each text (ids, counts)."""
        if self.index is None:
            yield from ((self.base, []) for _ in texts)
            return
        for vote, near in self.index.votes(texts):
            if vote is None:
                yield self.base, []
            else:
                yield self.steps[1][max(0, bisect_right(self.steps[0], vote) - 1)], near


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from ``labels`` (doc_id, toxic).  What reaches the driver is bounded:
    about ``examples`` documents a class, as their words and vectors."""
    model, terms = fit_counted(docs, labels, examples)
    if terms is not None:
        release(terms)
    return model


def counted(docs: DataFrame, vectors) -> DataFrame:
    """(doc_id, ids, counts) of the terms of every document, as packed numbers."""
    def run(batches):
        for batch in batches:
            pairs = [vectors.value.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([p[k].astype(np.int32).tobytes() for p in pairs], pa.binary())
                                    for k in (0, 1))], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, counts binary")


def fit_counted(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Model, DataFrame | None]:
    """What :func:`fit` learns, and the staged :func:`counted` table of all documents
    that it counted them by; there is none where nothing can be learned."""
    spark = docs.sparkSession
    prepare(spark)
    known = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
             .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if len(size) < 2:
        return Model(Vectors(()), None, float(bool(size.get(1)))), None
    drawn = known.filter(F.when(F.col("toxic") == 1, share(F.col("doc_id")) < examples / size[1])
                         .otherwise(share(F.col("doc_id")) < examples / size[0]))
    # About 2 x ``examples`` rows of two numbers.
    drawn = drawn.withColumnRenamed("doc_id", "key")
    texts = staged(
        docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(drawn), "key")
        .groupBy("key", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "examples")
    got = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return Model(Vectors(()), None, size[1] / total), None
    # All words of the examples.
    words = (texts.select("text", "toxic").mapInArrow(_class_counts, "term string, clean long, toxic long")
             .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .toArrow().sort_by("term"))
    if not len(words):
        return Model(Vectors(()), None, size[1] / total), None
    vectors = Vectors(tuple(words.column("term").to_pylist()))
    held = spark.sparkContext.broadcast(vectors)
    made = staged(counted(docs, held), "terms")

    # How many of all documents have each term: a task adds up its own.
    def having(batches):
        n, have = 0, np.zeros(len(held.value.terms), np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            have += np.bincount(ids, minlength=len(have))
            n += batch.num_rows
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *some.tolist()], pa.int32()), pa.array([n, *have[some].tolist()], pa.int64())], ["term", "n"])

    found = (made.select("ids").mapInArrow(having, "term int, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    df = np.zeros(len(words) + 1)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    classes = np.stack([words.column(c).to_numpy() for c in ("clean", "toxic")], axis=1)
    strength = np.sqrt(association(classes, (got[0], got[1])))
    strength = strength / strength.max() if strength.max() > 1e-9 else np.ones(len(words))
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * strength

    of_examples = counted(texts.select(F.col("key").alias("doc_id"), "text"), held).withColumnRenamed("doc_id", "key")
    examples_ = of_examples.join(F.broadcast(texts.select("key", "toxic")), "key").toArrow().sort_by("key")
    unpacked = [np.frombuffer(raw, np.int32) for raw in examples_.column("ids").to_pylist()]
    times = [np.frombuffer(raw, np.int32) for raw in examples_.column("counts").to_pylist()]
    told_by = list(zip(examples_.column("key").to_pylist(), examples_.column("toxic").to_pylist(), unpacked, times))
    # An example stands for so many of its class's labels.
    weight = {c: size[c] / got[c] for c in (0, 1)}
    full = [e for e in told_by if len(e[2])]
    # Examples of one leading term lie together, so that blocks have few terms.
    full.sort(key=lambda e: (int(e[2][np.argmax((1 + np.log(e[3])) * idf[e[2]])]), e[2].tolist(), e[0]))
    index = Index.build(idf, full)
    votes = [v for v, _ in index.votes([e[2:] for e in full], range(len(full)))]
    empty = [e[1] for e in told_by if not len(e[2])] + [e[1] for e, v in zip(full, votes) if v is None]
    toxic = sum(weight[1] for c in empty if c)
    base = toxic / max(1e-9, toxic + sum(weight[0] for c in empty if not c)) if empty else size[1] / total
    told = [(v, e[1]) for e, v in zip(full, votes) if v is not None]
    if not told:
        return Model(vectors, None, size[1] / total), made
    x, y = (np.array(c, float) for c in zip(*told))
    return Model(vectors, index, base, monotone(x, y, np.array([weight[int(c)] for c in y]))), made


def _judged(model: Model, texts: list[tuple[np.ndarray, np.ndarray]]):
    """(score, evidence) of each text (ids, counts); texts alike share one."""
    alike = [(ids.tobytes(), counts.tobytes()) for ids, counts in texts]
    different = dict(zip(alike, texts))
    known = {key: (score, [{"doc_id": model.index.key[i], "cosine": c} for i, c in near[:3]])
             for key, (score, near) in zip(different, model.scores(list(different.values())))}
    return [known[key] for key in alike]


def scores(docs: DataFrame, model: Model, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, evidence) of every document; evidence has the ids and
    cosines of the nearest examples.  ``terms`` is the :func:`counted` table of the
    documents, where it has been made."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)
    schema = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        for batch in batches:
            columns = ([np.frombuffer(raw, np.int32) for raw in batch.column(k).to_pylist()] for k in (1, 2))
            got = _judged(held.value, list(zip(*columns)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], kind)],
                ["doc_id", "score", "evidence"])

    if terms is None:
        terms = counted(docs, spark.sparkContext.broadcast(model.vectors))
    return terms.mapInArrow(run, schema)


def score_of(text: Column, spark: SparkSession, model: Model) -> Column:
    """The score as a column, for filters that keep the rest of the row."""
    prepare(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        counts = [held.value.vectors.counts(t) for t in texts]
        return pd.Series([s for s, _ in _judged(held.value, counts)], dtype=float)

    return score(text.cast("string"))


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that are not held out."""
    return table(spark, sf_dir, "labels").filter(digit("doc_id", 5) != 0)


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learn from the labels that are not held out."""
    return fit(docs, taught(spark, sf_dir))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, terms = fit_counted(docs, taught(spark, sf_dir))
    return scores(docs, model, terms).select(
        "doc_id", (digit("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
