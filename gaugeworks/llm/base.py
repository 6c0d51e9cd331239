"""What the text operators share: tables, staged copies, batches and word tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.session import discard, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of an Arrow batch.  Spark bounds batches by rows alone, so that this,
#: times the longest text, is what a Python worker holds at a time.
BATCH_ROWS = 1024


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that checks it where SQL can say it."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session to ``BATCH_ROWS`` rows or fewer, and
    let Python workers find this package where the driver found it.  On a cluster
    whose machines lack that folder, submit the package with ``--py-files``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    home = str(Path(__file__).resolve().parents[2])
    told = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in told.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (home, told)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy is computed once whatever reads it, survives lost executors, and
    fixes values that a second run of the tasks could order otherwise.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        discard(df.sparkSession, folder)


def share(key: Column) -> Column:
    """A number from 0 to 1 that is a fixed function of ``key``."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def digit(id_column: str, divisor: int) -> Column:
    """Remainder of the checksum of an id's text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % divisor


class WordTable(dict):
    """What a function gives for each word, kept up to ``limit`` words.

    Python has the loop over a text's words in C this way:
    ``b"".join(map(table.__getitem__, text.split()))``.
    """

    def __init__(self, function: Callable[[str], bytes], limit: int = 400_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self.function(word)
        if len(word) <= 64:
            self[word] = value
        return value
