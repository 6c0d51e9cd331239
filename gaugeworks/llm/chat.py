"""Chat formatting in budgeted windows.

A conversation is cut into windows of at most a budget of tokens, at turn
bounds.  A window has the conversation's system turn, the last turns before it
as far as the history budget reaches, and as many new turns as the prefix sums
of turn tokens allow.  Spans mark what is trained on: the assistant texts among
the new turns.  Repeated turns are never marked, so that every assistant text
is trained on once.

Turns are written ``<turn role>``, a line break, the text and ``</turn>``, a
line break.  In roles and texts a backslash goes before every backslash and
angle bracket, so that no text can pass for a control string and reading back
gives the text as it was.

Turns are ordered by number, nulls first, then by role and text; repeated rows
are turns of their own.  Null texts and roles are empty.  Null ids make up one
conversation.  A turn longer than the budget has a window of its own and is
kept whole.  An empty table gives no windows.

A long conversation is cut at fixed turn numbers first, so that no task has
all of it: a piece gets copies of the system turn and of the few turns before
it, and its windows are built like any other's.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import prepare, query, table
from gaugeworks.llm.packing import encoder, public_files

_ESCAPE = re.compile(r"([\\<>])")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


@dataclass(frozen=True)
class Budget:
    tokens: int = 2048  # of a window
    history_tokens: int = 256  # of the repeated turns but the system turn
    history_turns: int = 8
    piece_turns: int = 512  # turn numbers of a piece


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends."""
    head = f"<turn {escape(role)}>\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


_SYSTEM, _BEFORE, _OWN = 0, 1, 2


@dataclass
class _Turn:
    role: str
    whole: str
    begin: int
    end: int
    total: int  # tokens of the piece's turns up to and with this one
    tokens: int


class _Piece:
    """The windows of one piece, as its turns come in.  Holds a window's turns
    and the history before it."""

    def __init__(self, budget: Budget, count):
        self.budget, self.count = budget, count
        self.system: _Turn | None = None
        self.history: list[_Turn] = []
        self.repeated: list[_Turn] = []
        self.new: list[_Turn] = []
        self.number = self.total = 0

    def _head(self) -> int:
        return sum(t.tokens for t in self.repeated)

    def _open(self, first: _Turn) -> None:
        """Choose what the next window repeats, given its first new turn."""
        system = [self.system] if self.system else []
        room = min(self.budget.history_tokens,
                   self.budget.tokens - first.tokens - sum(t.tokens for t in system))
        end = self.history[-1].total if self.history else 0
        self.repeated = system + [t for t in self.history if end - t.total + t.tokens <= room]

    def _keep(self, turns: list[_Turn]) -> None:
        """Add to the history, of which the last turns are held: any number of rows
        may share a turn number."""
        self.history += turns
        del self.history[:max(0, len(self.history) - self.budget.history_turns)]

    def add(self, kind: int, role: str, text: str):
        """A window that this turn completes, or None."""
        whole, begin, end = formatted(role, text)
        tokens = self.count(whole)
        if kind == _SYSTEM:
            self.system = _Turn(role, whole, begin, end, 0, tokens)
            return None
        self.total += tokens
        turn = _Turn(role, whole, begin, end, self.total, tokens)
        if kind == _BEFORE:
            self._keep([turn])
            return None
        done = None
        if self.new:
            before = self.new[0].total - self.new[0].tokens
            if self._head() + turn.total - before > self.budget.tokens:
                done = self.close()
        if not self.new:
            self._open(turn)
        self.new.append(turn)
        return done

    def close(self):
        """(number, text, spans, new turns, repeated turns, tokens) of the open window."""
        if not self.new:
            return None
        turns, spans, at = self.repeated + self.new, [], 0
        for k, t in enumerate(turns):
            if k >= len(self.repeated) and t.role == "assistant":
                spans.append({"start": at + t.begin, "end": at + t.end})
            at += len(t.whole)
        row = (self.number, "".join(t.whole for t in turns), spans, len(self.new), len(self.repeated),
               sum(t.tokens for t in turns))
        self._keep(self.new)
        # The system turn itself, met as the first own turn, is repeated as such.
        if self.system is None and self.number == 0 and self.new[0].role == "system" and not self.repeated:
            self.system = self.new[0]
            self.history = [t for t in self.history if t is not self.system]
        self.new, self.number = [], self.number + 1
        return row


_WINDOW = ("conv_id long, piece long, window int, text string, spans array<struct<start: long, end: long>>, "
           "n_turns int, n_repeated int, n_tokens int")
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(),
          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int32(), pa.int32(), pa.int32()]


def _windows(budget: Budget, files: tuple[str, str, str]):
    def run(batches):
        codes = encoder(*files)
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", _WINDOW)]
        open_, key = None, None
        rows: list[tuple] = []

        def flush():
            columns = zip(*rows) if rows else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], names)
            rows.clear()
            return made

        for batch in batches:
            for conv, piece, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or key != (conv, piece):
                    if open_ and (row := open_.close()):
                        rows.append((*key, *row))
                    open_, key = _Piece(budget, lambda t: len(codes.ids(t))), (conv, piece)
                if row := open_.add(kind, role, text):
                    rows.append((*key, *row))
            yield flush()
        if open_ and (row := open_.close()):
            rows.append((*key, *row))
        yield flush()
    return run


def windows(turns: DataFrame, budget: Budget = Budget(), files: tuple[str, str, str] | None = None) -> DataFrame:
    """The windows of conversations (conv_id, turn, role, text), in the order of
    piece and window."""
    prepare(turns.sparkSession)
    said = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = budget.piece_turns
    said = said.withColumn("piece", F.coalesce(F.floor(F.col("turn") / size), F.lit(-(1 << 62))))
    own = said.withColumn("kind", F.lit(_OWN))
    before = (said.filter(F.pmod("turn", F.lit(size)) >= size - budget.history_turns)
              .withColumn("piece", F.col("piece") + 1).withColumn("kind", F.lit(_BEFORE)))
    # The first turn of a conversation, if it is the system's, for its later pieces.
    head = (said.groupBy("conv_id").agg(F.min(F.struct("piece", "turn", "role", "text")).alias("head"))
            .filter(F.col("head.role") == "system").select(F.col("conv_id").alias("h_id"), "head"))
    later = (said.select("conv_id", "piece").distinct()
             .join(head, F.col("conv_id").eqNullSafe(F.col("h_id")) & (F.col("piece") > F.col("head.piece")))
             .select("conv_id", F.col("head.turn").alias("turn"), F.col("head.role").alias("role"),
                     F.col("head.text").alias("text"), "piece", F.lit(_SYSTEM).alias("kind")))
    dealt = own.unionByName(before).unionByName(later).repartition("conv_id", "piece")
    return (dealt.sortWithinPartitions("conv_id", "piece", "kind", "turn", "role", "text")
            .select("conv_id", "piece", "kind", "role", "text")
            .mapInArrow(_windows(budget, files or public_files()), _WINDOW))


def _digest(batches):
    """Read windows back, conversation by conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, state = None, None
    done: list[tuple] = []

    def close():
        n, turns, chars, loss, formatted_chars = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars))

    def flush():
        columns = zip(*done) if done else [[]] * len(names)
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)
        done.clear()
        return made

    for batch in batches:
        for conv, text, spans, repeated in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv != key:
                if state:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"]:span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        yield flush()
    if state:
        close()
    yield flush()


def digests(made: DataFrame) -> DataFrame:
    """What the windows of each conversation read back to.  A digest over a whole
    conversation runs through its windows one by one, in one task that holds a
    window at a time."""
    prepare(made.sparkSession)
    return (made.select("conv_id", "piece", "window", "text", "spans", "n_repeated")
            .repartition("conv_id").sortWithinPartitions("conv_id", "piece", "window")
            .select("conv_id", "text", "spans", "n_repeated")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long"))


@query("op7_chat")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(added)))
