"""Ingest of landed responses, once per station and year.

A station-year that is already stored is never fetched or written again, and
among responses landed together the first one wins.  Every ingest has an id and
owns its folders; it looks only at what *other* ingests stored, so running it
again after a lost job rebuilds exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions import dates
from gaugeworks.operators.convert import convert_daily_strict, minimal
from gaugeworks.schemas import DAILY_COLUMNS, LANDED
from gaugeworks.session import discard, scratch
from gaugeworks.sources import snapshots, store
from gaugeworks.sources.responses import strict_records

_REQUEST = ("request_id", "landed_seq")


def first_responses(rows: DataFrame) -> DataFrame:
    """The first landed response of each station-year.

    Rows shrink to distinct responses by hashing before the least is taken.
    """
    return (
        rows.select("station_id", "year", *_REQUEST).distinct()
        .groupBy("station_id", "year")
        .agg(F.min(F.struct("landed_seq", "request_id")).alias("_first"))
        .select("station_id", "year", "_first.*")
    )


def pending_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of first responses for station-years that are not stored."""
    chosen = first_responses(rows).withColumn("data_type", F.lit("daily")).join(
        stored.select(*store.CHUNK_KEY), list(store.CHUNK_KEY), "left_anti")
    return rows.join(
        chosen.drop("data_type"), ["station_id", "year", *_REQUEST], "left_semi")


def of_whole_requests(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of requests without a refused page: a request succeeds or fails whole."""
    refused = records.where(F.col("reject").isNotNull()).select("request_id").distinct()
    return rows.join(refused, "request_id", "left_anti")


def scan_outcomes(records: DataFrame, *keys: str) -> DataFrame:
    """Records and first error per ``keys``; a refused page fails the whole group.

    Only the date decides whether a strict record is stored, so counting needs
    no conversion.
    """
    day = dates.days_since_epoch(dates.lenient_date(F.col("Date")))
    # Grouping by the reason first lets both steps hash instead of sort.
    counted = records.groupBy(*keys, "reject").agg(F.count_if(day > 0).alias("_stored"))
    return counted.groupBy(*keys).agg(
        F.min("reject").alias("error"), F.sum("_stored").alias("_stored"),
    ).select(
        *keys,
        F.when(F.col("error").isNull(), F.col("_stored")).otherwise(F.lit(0)).alias("records"),
        "error",
    )


def ingest_batch(
    landed: DataFrame, root: str, ingest_id: str, dry_run: bool = False,
    spark: SparkSession | None = None,
) -> None:
    """Store what is new in ``landed`` and record files, chunks and the fetch log.

    A streaming batch comes with a session of its own in which adaptive
    execution may be off; every step after the first runs in ``spark``.
    """
    spark = spark or landed.sparkSession
    # Bodies are parsed once; the compact rows are read back for each later step.
    stage = scratch(spark, "stage")
    strict_records(landed, *_REQUEST).write.parquet(stage)
    records = spark.read.parquet(stage)
    rows = convert_daily_strict(minimal(records.where(F.col("Date").isNotNull())), _REQUEST)
    others = snapshots.read_catalog(spark, root).where(F.col("ingest_id") != ingest_id)
    fresh = pending_rows(of_whole_requests(rows, records), others)
    if not dry_run:
        store.write_obs(fresh.select(*DAILY_COLUMNS), root, "daily", ingest_id)
        store.write_catalog(spark, root, "daily", ingest_id)
        snapshots.publish(spark, root, "daily", ingest_id)
    # A request whose station-years were stored before succeeds with no records.
    taken = fresh.groupBy("request_id").agg(F.count("*").alias("taken"))
    log = scan_outcomes(records, "request_id", "station_id").join(taken, "request_id", "left")
    log.select(
        "request_id", "station_id", F.coalesce("taken", F.lit(0)).alias("records"), "error",
        F.col("error").isNull().alias("success"),
    ).write.mode("overwrite").parquet(f"{root}/fetch_log/ingest_id={ingest_id}")
    discard(spark, stage)


def ingest_stream(
    spark: SparkSession, landing: str, root: str, checkpoint: str, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Ingest everything that has landed since the last run, then stop."""
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, root, f"batch-{number:09d}", spark=spark)

    return (
        reader.json(landing)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
