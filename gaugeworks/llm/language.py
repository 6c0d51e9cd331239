"""Language identification in two steps with linear support vector machines.

First the language family is chosen, then the language within it; both times
by one-versus-one machines.  A text is its hashed byte trigrams: lower-cased,
everything but letters blanked, square roots of counts, scaled to length one.
The whole text counts.

Machines learn from a bounded sample of each language, one task per machine.
Scoring is one product of a batch of texts with all machines' weights.

A text that is null or has no letter is ``und`` with score 0.  A tie between
languages goes to the name that sorts first.  Repeated rows repeat their
result.  With one learned language all other texts are of it; with none they
are ``und``.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import digit, prepare, query, share, table

#: Hash buckets of trigrams, and documents learned from a language (their
#: expected number).
BUCKETS, EXAMPLES = 4096, 400

# Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn hi mr ne pa ur",
    "turkic": "az kk tr uz",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """A language of no listed family is a family of its own."""
    return _FAMILY.get(lang, lang)


_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Unit vector of a text; None where it has no letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    raw = np.frombuffer((" " + text.lower() + " ").encode().translate(_BLANK), np.uint8)
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]].astype(np.uint32)  # one blank at a time
    gram = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)
    count = np.bincount((gram ^ gram >> np.uint32(15)) % np.uint32(buckets), minlength=buckets)
    vector = np.sqrt(count).astype(np.float32)
    return vector / np.float32(np.linalg.norm(vector))


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the constant) of a machine with squared hinge loss;
    y is -1 or 1, and both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, last, step = w.copy(), w, 0.2
    for k in range(rounds):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ ahead))
        w = ahead + step * (2 * (x.T @ (weight * slack * y)) - penalty * ahead)
        ahead, last = w + k / (k + 3) * (w - last), w
    return w


@dataclass
class Model:
    """``machines``: (first, second, family or None); a positive margin says first."""

    languages: list[str]
    machines: list[tuple[str, str, str | None]]
    weights: np.ndarray

    def _choose(self, names: list[str], within: str | None, margin: np.ndarray) -> tuple[str, float]:
        """Most won duels, then the largest sum of margins, then the name."""
        if len(names) == 1:
            return names[0], 1.0
        won, total, worst = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (a, b, group), m in zip(self.machines, margin):
            if group != within:
                continue
            sure = 1 / (1 + np.exp(-3.0 * float(m)))
            won[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + float(m), total[b] - float(m)
            worst[a], worst[b] = min(worst[a], sure), min(worst[b], 1 - sure)
        best = min(names, key=lambda n: (-won[n], -total[n], n))
        return best, worst[best]

    def predict(self, margin: np.ndarray) -> tuple[str, float]:
        group, sure = self._choose(sorted({family(x) for x in self.languages}), None, margin)
        lang, surer = self._choose([x for x in self.languages if family(x) == group], group, margin)
        return lang, sure * surer


def duels(languages: list[str]) -> list[tuple[str, str, str | None]]:
    groups = sorted({family(x) for x in languages})
    return [(a, b, None) for a, b in combinations(groups, 2)] + [
        (a, b, g) for g in groups for a, b in combinations([x for x in languages if family(x) == g], 2)]


def fit(docs: DataFrame, examples: int = EXAMPLES, buckets: int = BUCKETS) -> Model:
    """Learn from documents (doc_id, text, lang).  About ``examples`` of each
    language are drawn by a fixed function of their ids and texts."""
    spark = docs.sparkSession
    prepare(spark)
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                        F.col("lang").cast("string")).filter("lang IS NOT NULL")
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size)
    machines = duels(languages)
    if not machines:
        return Model(languages, [], np.zeros((0, buckets + 1), np.float32))
    rate = F.coalesce(*(F.when(F.col("lang") == x, F.lit(examples / size[x])) for x in languages))
    # By id and text, each once: rows that share an id, or have none, do not come in bulk.
    drawn = known.filter(share(F.xxhash64("doc_id", "text")) < rate).dropDuplicates(["doc_id", "text", "lang"])

    def vectorize(batches):
        for batch in batches:
            pairs = [(lang, features(t, buckets)) for lang, t in
                     zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            pairs = [(lang, v) for lang, v in pairs if v is not None]
            # A copy of the row for each machine that its language is a side of.
            rows = [(k, 1 if a == (lang if g else family(lang)) else -1, v.tobytes())
                    for lang, v in pairs for k, (a, b, g) in enumerate(machines)
                    if (lang if g else family(lang)) in (a, b) and (g is None or family(lang) == g)]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))],
                ["machine", "side", "vector"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vector"]), np.float32).reshape(len(pdf), -1)
        y = pdf["side"].to_numpy().astype(np.float32)
        w = train(x, y) if len(set(y.tolist())) == 2 else np.r_[np.zeros(buckets), y[0]].astype(np.float32)
        return pd.DataFrame({"machine": pdf["machine"].iloc[:1], "weights": [w.tobytes()]})

    solved = (drawn.select("text", "lang").mapInArrow(vectorize, "machine int, side int, vector binary")
              .groupBy("machine").applyInPandas(solve, "machine int, weights binary").collect())
    weights = np.zeros((len(machines), buckets + 1), np.float32)
    for r in solved:
        weights[r["machine"]] = np.frombuffer(r["weights"], np.float32)
    return Model(languages, machines, weights)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document (doc_id, text)."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple[str, float]] = []
            for at in range(0, len(texts), 256):
                vectors = [features(t, model.weights.shape[1] - 1) for t in texts[at:at + 256]]
                some = [v for v in vectors if v is not None]
                margin = iter(np.stack(some) @ model.weights[:, :-1].T + model.weights[:, -1] if some else ())
                out += [("und", 0.0) if v is None or not model.languages else model.predict(next(margin))
                        for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in out], pa.string()),
                 pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(digit("doc_id", 4) != 2))
    return predictions(docs, model).select(
        "doc_id", (digit("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
