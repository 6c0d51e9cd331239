"""Job reports: retry decisions, schedules, dry runs, the summary as JSON, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.functions import texts
from gaugeworks.operators.stats import PHASES, fetch_summary


def retry_class(log: DataFrame) -> DataFrame:
    return log.select(
        "ordinal", "status_code", "error",
        texts.should_retry(F.col("error"), F.col("status_code")).alias("should_retry"),
    )


def retry_schedule(log: DataFrame, max_retries: int) -> DataFrame:
    """Attempts each request may make, with the wait before and the jitter bound."""
    attempt = F.explode(F.sequence(F.lit(0), F.lit(max_retries))).alias("attempt")
    wait = texts.backoff_seconds(F.col("attempt"))
    return log.select("ordinal", attempt).select(
        "ordinal", "attempt",
        wait.alias("wait_s"),
        (wait.cast("double") / 2).alias("max_jitter_s"),
    )


def ingest_dry_run(obs: DataFrame) -> DataFrame:
    """What an ingest would store, without writing."""
    return obs.groupBy("station_id").agg(F.count("*").alias("records"))


def fetch_summary_json(log: DataFrame) -> DataFrame:
    """The summary and every result as JSON lines, totals first.

    A single document would gather all results in one row, so each is a line.
    """
    totals = fetch_summary(log).select(
        F.lit(-1).cast("bigint").alias("line"),
        F.to_json(F.struct(
            F.col("stations").alias("total_stations"), "successful", "failed", "total_records",
        )).alias("json"),
    )
    timings = F.struct(*(F.col(p) for p in PHASES))
    results = log.select(
        F.col("ordinal").cast("bigint").alias("line"),
        F.to_json(F.struct(
            "station_id", "year", "success", "records", "attempts", "error",
            timings.alias("timings"), "bytes_transferred",
        )).alias("json"),
    )
    return totals.unionByName(results)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
