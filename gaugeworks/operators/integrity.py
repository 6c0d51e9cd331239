"""Checks of what has been written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.sources import snapshots
from gaugeworks.sources.store import _below_root, chunk_files, read_files, station_group


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """Files that take part in verification; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def _per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file").agg(
        F.sum("row_count").alias("row_count"), F.sum("checksum").alias("checksum"))


def _expected(spark: SparkSession, root: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Files that should be there with rows and checksum, and all that are on disk but
    for those which a later snapshot has replaced."""
    recorded = _per_file(read_files(spark, root).where(F.col("data_type") == kind))
    listed = list_files(spark, f"{root}/data_type={kind}").select(
        _below_root(F.col("path")).alias("file"), "length")
    at = snapshots.latest(spark, root, kind)
    if at is None:
        return recorded, listed
    live = _per_file(snapshots.files(spark, root, kind, at))
    replaced = recorded.join(live, "file", "left_anti").select("file")
    return live, listed.join(replaced, "file", "left_anti")


def verify_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Read every stored file in full and compare with what was recorded for it.

    The scan splits large files over tasks and skips what it cannot decode, so a
    damaged file shows as missing rows or as another checksum.
    """
    recorded, listed = _expected(spark, root, kind)
    expected = recorded.select(
        "file", F.col("row_count").alias("expected_rows"), F.col("checksum").alias("expected_checksum"))
    found = _per_file(chunk_files(spark, root, kind, tolerant=True)).select(
        "file", F.col("row_count").alias("rows_read"), F.col("checksum").alias("read_checksum"))
    joined = listed.join(found, "file", "left").join(expected, "file", "full")
    problem = (
        F.when(F.col("length").isNull(), "file is gone")
        .when(F.col("length") == 0, "file is empty")
        .when(F.col("rows_read").isNull(), "file cannot be read")
        .when(F.col("expected_rows").isNull(), "file is not recorded")
        .when(F.col("rows_read") != F.col("expected_rows"), "rows are missing")
        .when(F.col("read_checksum") != F.col("expected_checksum"), "rows differ")
    )
    return joined.select(
        "file", F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        problem.isNull().alias("ok"), problem.alias("error"),
    )


def skipped_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Files a tolerant read leaves out in whole or part, and why."""
    return verify_files(spark, root, kind).where(~F.col("ok")).select("file", "error")


def verify_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("failed"))


def nonempty_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Recorded files with whether each exists and has any bytes."""
    recorded, listed = _expected(spark, root, kind)
    return recorded.select("file").join(listed, "file", "left").select(
        "file", F.coalesce(F.col("length") > 0, F.lit(False)).alias("written"))


def readback_diff(written: DataFrame, read: DataFrame) -> DataFrame:
    """Counts of both sides and of the rows only one side has, repeats included.

    One shuffle over the union; equal rows combine before it.
    """
    columns = written.columns
    signed = written.withColumn("_side", F.lit(1)).unionByName(
        read.select(*columns).withColumn("_side", F.lit(-1)))
    balance = signed.groupBy(*columns).agg(
        F.sum("_side").alias("_left_over"),
        F.count_if(F.col("_side") == 1).alias("_written"),
        F.count_if(F.col("_side") == -1).alias("_read"),
    )
    over = F.col("_left_over")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return balance.agg(
        total(F.col("_written")).alias("rows_written"),
        total(F.col("_read")).alias("rows_read"),
        total(F.greatest(over, F.lit(0))).alias("only_written"),
        total(F.greatest(-over, F.lit(0))).alias("only_read"),
    )


#: Days or hours that one part of a comparison spans.
PART_SPAN = 64


def _parts(rows: DataFrame) -> list[Column]:
    """Levels of a part, from the year down to a segment of time."""
    return [F.col("year").alias("_year"), station_group(F.col("station_id")).alias("_group"),
            F.floor(F.col("ts") / PART_SPAN).alias("_segment")]


def differing_parts(written: DataFrame, read: DataFrame) -> DataFrame:
    """Parts (year, station group, segment of time) whose rows or checksums differ.

    Checksums add up, so each side is one row a part before anything is compared, and
    parts that are equal end there.
    """
    def summed(rows, side):
        total = F.sum(F.xxhash64(*written.columns).cast("decimal(20,0)"))
        return rows.groupBy(*_parts(rows)).agg(F.count("*").alias(f"{side}_rows"), total.alias(f"{side}_sum"))

    levels = ["_year", "_group", "_segment"]
    both = summed(written, "w").join(summed(read.select(*written.columns), "r"), levels, "full")
    same = F.col("w_rows").eqNullSafe(F.col("r_rows")) & F.col("w_sum").eqNullSafe(F.col("r_sum"))
    return both.where(~same).select(*levels)


def located_diff(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side and how often; the rows of equal parts
    are not shuffled, only their checksums."""
    columns, levels = written.columns, ["_year", "_group", "_segment"]
    parts = differing_parts(written, read)

    def suspects(rows, sign):
        placed = rows.select(*columns, *_parts(rows))
        return placed.join(parts, levels, "left_semi").select(*columns, F.lit(sign).alias("_side"))

    signed = suspects(written, 1).unionByName(suspects(read.select(*columns), -1))
    left = signed.groupBy(*columns).agg(F.sum("_side").alias("_over")).where("_over <> 0")
    return left.select(*columns, F.when(F.col("_over") > 0, "written").otherwise("read").alias("side"),
                       F.abs("_over").alias("times"))


def union_stations(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All records of several results, repeats kept."""
    for other in rest:
        first = first.unionByName(other)
    return first
