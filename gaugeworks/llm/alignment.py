"""Alignment of the tokens that two tokenizers cut the same texts into.

A text is taken with a space before it, as the second tokenizer reads it.  All
tokens of both, as byte ranges, are sorted by start; where a start reaches the
running maximum of the ends a new group begins, and within a group every pair
of tokens whose ranges overlap is a link.  How often a pair of ids is linked is
counted over all texts, and a text's links are rated by these counts.

Both tokenizers cut at a space that follows a letter or sign, and what they do
on either side does not depend on the other, so that a very long text is tokenized
in stretches between such spaces.  Alignment is done for many whole texts at a time.

Texts are read once.  A task cuts its texts into chunks of a bounded number of
tokens (a longer text is a chunk of its own) and writes one row a chunk: its
texts' figures, and their links as places in the chunk's list of different
pairs.  Only the pair lists, with counts, are added up over the corpus; the
totals return to the chunks by key, so that nothing grows with the vocabulary
in one place.

Null and empty texts, and texts that the tokens of either do not give back (the
second reads U+2581 as a space), have no tokens, and zeros throughout.  A
repeated row is a text of its own and counts again; null ids are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import packing
from gaugeworks.llm.base import prepare, query, staged, table

#: Tokens of both tokenizers after which a chunk ends.
CHUNK_TOKENS = 400_000

#: Characters after which a long text is cut for the tokenizers.
_STRETCH_CHARS = 16_384

#: Characters of texts that are tokenized together; a longer text is by itself.
_SLAB_CHARS = 1_000_000

#: A pair of ids as one number.
_SHIFT = 32

#: Before a space that follows a letter or sign, and that does not end the text.
_CUT = re.compile(r"(?<=\S)(?= (?s:.))")


def public_files() -> tuple[str, str, str, str]:
    """Tokenizer file, rank file and split pattern of the first, piece model of the
    second of the public vocabularies."""
    import public_tokenizers

    return *packing.public_files(), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones
    of Latin-1 stand for themselves, others for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Ids and byte lengths of a text's tokens under both tokenizers.

    Most texts' ids of the first come from the rank file of the same vocabulary, as
    :class:`packing.Encoder` says; names of special tokens are plain text to both files.
    """

    def __init__(self, byte_file: str, rank_file: str, pattern: str, piece_file: str):
        from sentencepiece import SentencePieceProcessor

        self.ranks = packing.encoder(byte_file, rank_file, pattern).ranks
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_file)
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(map(letters.__getitem__, e)) if set(e) <= letters.keys() else e.encode()
                        for e, i in entries.items()}
        self.b_bytes = dict(enumerate(map(self._piece, range(self.b.vocab_size()))))
        self.ids = 1 + max(*self.a_bytes, *self.b_bytes)
        self.a_length, self.b_length = (
            np.array([len(of.get(i, b"")) for i in range(self.ids)], np.int32) for of in (self.a_bytes, self.b_bytes))
        # Pieces that go on behind an inner space would tie stretches together.
        self.apart = not any(b" " in p.lstrip(b" ") for p in self.b_bytes.values())
        # Each id in decimals, with each of the signs that may follow it.
        self.signed = np.array([f"{i}{sign}" for sign in ",|;" for i in range(self.ids)], object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def stretches(self, text: str) -> list[str]:
        """The text with a space before it, cut where neither tokenizer notices."""
        spaced, out, at = " " + text, [], 0
        while self.apart and len(spaced) - at > _STRETCH_CHARS:
            cut = _CUT.search(spaced, at + _STRETCH_CHARS)
            if cut is None:
                break
            out.append(spaced[at:cut.start()])
            at = cut.start()
        return [*out, spaced[at:]]

    def _first(self, stretch: str, raw: bytes) -> np.ndarray | None:
        """Ids of the first tokenizer; nothing where they do not give the bytes back."""
        if raw.isascii() or max(raw) < packing._PLAIN_BELOW:
            ids = self.ranks.encode_to_numpy(stretch).astype(np.int32)
            # Ranks are of the text's own bytes, so that only missing ones could differ.
            return ids if int(self.a_length[ids].sum()) == len(raw) else None
        ids = self.a.encode(stretch, add_special_tokens=False).ids
        return np.array(ids, np.int32) if b"".join(map(self.a_bytes.__getitem__, ids)) == raw else None

    def _second(self, ids: list[int], raw: bytes) -> np.ndarray | None:
        return np.array(ids, np.int32) if b"".join(map(self.b_bytes.__getitem__, ids)) == raw else None

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, ...] | None]:
        """Ids and lengths of whole texts under both; None where a text has no tokens."""
        cut = [self.stretches(t) if t else [] for t in texts]
        # The second tokenizer puts a space before a text by itself.
        b_ids = iter(self.b.encode([s[1:] for stretches in cut for s in stretches], num_threads=1))
        out = []
        for stretches in cut:
            raws = [stretch.encode() for stretch in stretches]
            b = [self._second(next(b_ids), raw) for raw in raws]
            a = [self._first(stretch, raw) for stretch, raw in zip(stretches, raws)]
            if not stretches or any(x is None for x in (*a, *b)):
                out.append(None)
                continue
            a, b = (side[0] if len(side) == 1 else np.concatenate(side) for side in (a, b))
            out.append((a, self.a_length[a], b, self.b_length[b]))
        return out


_TOKENIZERS: dict[tuple[str, ...], Tokenizers] = {}


def tokenizers(*files: str) -> Tokenizers:
    """The worker's tokenizers, loaded once."""
    if files not in _TOKENIZERS:
        _TOKENIZERS[files] = Tokenizers(*files)
    return _TOKENIZERS[files]


@dataclass
class Aligned:
    """Groups and links of ranges; A's come first among the tokens."""

    order: np.ndarray  # tokens by group, A's before B's
    group: np.ndarray  # of each token in that order
    a: np.ndarray  # links, as places among A's and B's ranges
    b: np.ndarray


def align(a_start, a_end, b_start, b_end) -> Aligned:
    """Coalesce overlapping ranges of both sides into groups and link overlaps.

    Ranges of one side are in order and do not overlap each other.
    """
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.cumsum(breaks) - 1
    # Within a group, a token of A overlaps the B's from the first that ends after
    # its start to the last that starts before its end.
    first = np.searchsorted(b_end, a_start, side="right")
    many = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    a = np.repeat(np.arange(len(a_start)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many - first, many)
    by_side = np.argsort(2 * group + side[order], kind="stable")
    return Aligned(order[by_side], group[by_side], a, b)


class Chunk:
    """Whole texts that are aligned together."""

    def __init__(self):
        self.ids: list = []
        self.texts: list = []
        self.held = 0

    def add(self, doc_id, tokens) -> None:
        self.ids.append(doc_id)
        self.texts.append(tokens)
        self.held += 1 if tokens is None else len(tokens[0]) + len(tokens[2])

    def figures(self, both: Tokenizers) -> dict:
        """Columns of the texts, and the chunk's pairs with their counts."""
        n = len(self.ids)
        full = [t for t in self.texts if t is not None]
        has = np.array([t is not None for t in self.texts], bool)
        column = lambda k: np.concatenate([t[k] for t in full]).astype(np.int64) if full else np.zeros(0, np.int64)
        a, a_len, b, b_len = (column(k) for k in range(4))
        n_a, n_b = (np.zeros(n, np.int64) for _ in range(2))
        n_a[has], n_b[has] = ([len(t[k]) for t in full] for k in (0, 2))
        # One line of bytes, on which texts follow each other.
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        got = align(a_end - a_len, a_end, b_end - b_len, b_end)
        a_text, b_text = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        token_text = np.concatenate((a_text, b_text))[got.order]
        is_b = got.order >= len(a)
        last = np.ones(len(is_b), bool)  # of its side in its group
        last[:-1] = (got.group[1:] != got.group[:-1]) | (is_b[1:] != is_b[:-1])
        ends = np.where(last, 1 + is_b, 0)
        signs = both.signed[ends * both.ids + np.concatenate((a, b))[got.order]].tolist()
        cut = np.concatenate(([0], np.cumsum(n_a + n_b)))
        digests = [hashlib.sha256("".join(signs[i:j])[:-1].encode()).hexdigest() if j > i else ""
                   for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        link_text = a_text[got.a]
        pairs, place, counts = np.unique((a[got.a] << _SHIFT) | b[got.b], return_inverse=True, return_counts=True)
        # A text's links to one pair are one entry with its number.
        entries, times = np.unique(link_text * max(1, len(pairs)) + place, return_counts=True)
        entry_text, entry_pair = np.divmod(entries, max(1, len(pairs)))
        return {
            "doc_id": pa.array(self.ids, pa.int64()), "n_a": n_a, "n_b": n_b,
            "n_groups": np.bincount(token_text[np.r_[True, got.group[1:] != got.group[:-1]][:len(is_b)]], minlength=n),
            "n_links": np.bincount(link_text, minlength=n), "groups_sha256": digests,
            "entries": np.bincount(entry_text, minlength=n),
            "place": entry_pair.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(),
            "pairs": pairs, "counts": counts,
        }


_TEXT_COLUMNS = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
                 "groups_sha256": "string", "entries": "long"}
_CHUNK = ("chunk long, " + ", ".join(f"{n} array<{t}>" for n, t in _TEXT_COLUMNS.items())
          + ", place binary, times binary, pairs array<long>, counts array<long>")
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows that are tokenized together."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= _SLAB_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def chunks(docs: DataFrame, files: tuple[str, ...], chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row a chunk of texts of ``docs`` (doc_id, text)."""
    def row(number, chunk, both):
        got = chunk.figures(both)
        columns = [pa.array([number], pa.int64())]
        columns += [pa.array([got[n]], pa.list_(_ARROW[t])) for n, t in _TEXT_COLUMNS.items()]
        columns += [pa.array([got[n]], pa.binary()) for n in ("place", "times")]
        columns += [pa.array([got[n]], pa.list_(pa.int64())) for n in ("pairs", "counts")]
        return pa.RecordBatch.from_arrays(
            columns, ["chunk", *_TEXT_COLUMNS, "place", "times", "pairs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]):
        both = tokenizers(*files)
        number = TaskContext.get().partitionId() << 33
        chunk = Chunk()
        for ids, texts in _slabs(batches):
            for doc_id, tokens in zip(ids, both.texts(texts)):
                chunk.add(doc_id, tokens)
                if chunk.held >= chunk_tokens:
                    yield row(number, chunk, both)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield row(number, chunk, both)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _CHUNK)


def pair_totals(made: DataFrame) -> DataFrame:
    """(pair, total, best) over staged :func:`chunks`: how many links hold each pair
    of ids, and whether no other has more of those with its B id."""
    listed = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    # A group has a row per id of A at most, which the vocabulary bounds.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(of_b)).alias("best"))


def _rated(key, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Texts of one chunk, with the totals of its pairs."""
    order = np.argsort(pairs.column("pair").to_numpy())
    total = pairs.column("total").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order]
    out = {n: [] for n in _TEXT_COLUMNS} | {"n_best": [], "count_sum": []}
    for i in range(texts.num_rows):
        for n in _TEXT_COLUMNS:
            out[n] += texts.column(n)[i].as_py()
        place = np.frombuffer(texts.column("place")[i].as_py(), "<u4")
        times = np.frombuffer(texts.column("times")[i].as_py(), "<u4").astype(np.int64)
        many = np.array(texts.column("entries")[i].as_py(), np.int64)
        cut = np.concatenate(([0], np.cumsum(many)))
        for name, value in (("n_best", best), ("count_sum", total)):
            run = np.concatenate(([0], np.cumsum(times * value[place])))
            out[name] += (run[cut[1:]] - run[cut[:-1]]).tolist()
    return pa.table({n: pa.array(v, _ARROW[_TEXT_COLUMNS.get(n, "long")]) for n, v in out.items() if n != "entries"})


def align_documents(docs: DataFrame, files: tuple[str, ...] | None = None,
                    chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of
    every document."""
    made = staged(chunks(docs, files or public_files(), chunk_tokens), "aligned")
    totals = staged(pair_totals(made), "pairs")
    own = made.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    rated = own.join(totals, "pair").select("of", "pair", "total", "best")
    schema = ", ".join(f"{n} {t}" for n, t in _TEXT_COLUMNS.items() if n != "entries")
    return (made.drop("pairs", "counts").groupBy("chunk").cogroup(rated.groupBy("of"))
            .applyInArrow(_rated, schema + ", n_best long, count_sum long"))


def spans(text: str | None, files: tuple[str, ...] | None = None) -> list[tuple]:
    """(start, end, ids of A, ids of B) of each group of a text, whose bytes have a
    space before them; nothing where the text has no tokens."""
    got = tokenizers(*(files or public_files())).texts([text])[0]
    if got is None:
        return []
    a_end, b_end = np.cumsum(got[1]), np.cumsum(got[3])
    found = align(a_end - got[1], a_end, b_end - got[3], b_end)
    ids, stops = np.concatenate((got[0], got[2])), np.concatenate((a_end, b_end))
    out, start = [], 0
    for g in range(int(found.group[-1]) + 1):
        mine = found.order[found.group == g]
        stop = int(stops[mine].max())
        out.append((start, stop, ids[mine[mine < len(got[0])]].tolist(), ids[mine[mine >= len(got[0])]].tolist()))
        start = stop
    return out


@query("op13_align")
def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
