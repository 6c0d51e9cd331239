"""Aggregates over observations, the catalog and the job logs.

All of them combine on the map side, so a station that holds most of the rows
sends no more than one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.schemas import RECORD_WIDTH

PHASES = ("dns_ms", "tcp_ms", "tls_ms", "ttfb_ms", "read_ms", "decode_ms", "write_ms", "total_ms")


def daily_stats(obs: DataFrame, *by: str) -> DataFrame:
    """Temperature extremes and mean, total ET, rows; sums stay in integers."""
    temp, et = F.col("temperature"), F.col("et")
    n = F.count("*")
    return obs.groupBy(*by).agg(
        (F.min(temp) / 10.0).alias("min_temp"),
        (F.max(temp) / 10.0).alias("max_temp"),
        (F.sum(temp).cast("double") / (n * 10.0)).alias("avg_temp"),
        (F.sum(et).cast("double") / 100.0).alias("total_et"),
        n.alias("record_count"),
    )


def merged_daily_stats(catalog: DataFrame, *by: str) -> DataFrame:
    """What :func:`daily_stats` gives of the rows behind catalog entries, from the
    partial statistics recorded when they were written; no row is read."""
    n = F.sum("row_count")
    return catalog.groupBy(*by).agg(
        (F.min("min_temperature") / 10.0).alias("min_temp"),
        (F.max("max_temperature") / 10.0).alias("max_temp"),
        (F.sum("sum_temperature").cast("double") / (n * 10.0)).alias("avg_temp"),
        (F.sum("sum_et").cast("double") / 100.0).alias("total_et"),
        n.alias("record_count"),
    )


def _raw_bytes() -> Column:
    """Bytes of a catalog entry's rows as fixed-width records of its own kind."""
    widths = F.create_map(*(F.lit(x) for pair in RECORD_WIDTH.items() for x in pair))
    return F.col("row_count") * widths[F.col("data_type")]


def store_stats(catalog: DataFrame, stations: DataFrame) -> DataFrame:
    """One row about the whole store."""
    raw = _raw_bytes()
    zero = lambda total: F.coalesce(total, F.lit(0))
    chunks = catalog.agg(
        F.count("*").alias("chunk_count"),
        zero(F.sum("row_count")).alias("total_rows"),
        zero(F.sum("stored_bytes")).alias("total_bytes"),
        zero(F.avg(raw / F.col("stored_bytes"))).alias("avg_ratio"),
    )
    known = stations.agg(
        F.count("*").alias("station_count"),
        F.count_if(F.col("IsActive") == "True").alias("active_station_count"),
    )
    names = [*known.columns, *chunks.columns]
    both = known.unionByName(chunks, allowMissingColumns=True)
    return both.agg(*(F.max(n).alias(n) for n in names))


def fetch_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("stations"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("records"))), F.lit(0)).alias("total_records"),
    )


def fetch_timing(log: DataFrame) -> DataFrame:
    """Phase times of what succeeded, the error of what did not."""
    kept = lambda name, when: F.when(when, F.col(name)).alias(name)
    ok = F.col("success")
    return log.select(
        "ordinal", "station_id", "success", kept("records", ok),
        *(kept(p, ok) for p in PHASES), kept("error", ~ok),
    )


#: Size of the quantile sketches; the rank of what they give is within about 0.3 % of
#: the rank asked for, and beyond ``RANK_ERROR`` practically never.
SKETCH_SIZE, RANK_ERROR = 1600, 0.01


def timing_sketches(log: DataFrame, *by: str) -> DataFrame:
    """A quantile sketch of each phase's times, of what succeeded, per ``by``.

    Sketches are a few kilobytes whatever the log holds, and merge.
    """
    made = log.where("success").groupBy(*by).agg(
        *(F.kll_sketch_agg_bigint(F.col(p).cast("bigint"), F.lit(SKETCH_SIZE)).alias(p) for p in PHASES))
    return made.unpivot(list(by), list(PHASES), "phase", "sketch")


def merged_percentiles(sketches: DataFrame, **ranks: float) -> DataFrame:
    """Rows behind each phase's sketches, and the time at each of ``ranks``."""
    merged = sketches.groupBy("phase").agg(F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    return merged.select(
        "phase", F.kll_sketch_get_n_bigint("sketch").alias("fetches"),
        *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(rank)).alias(name) for name, rank in ranks.items()))


def storage_efficiency(catalog: DataFrame) -> DataFrame:
    """Stored size against the fixed-width size of the same rows."""
    raw = _raw_bytes()
    stored = F.col("stored_bytes")
    return catalog.select(
        "station_id", "year", "data_type", "row_count",
        raw.alias("raw_bytes"),
        stored.alias("stored_bytes"),
        F.when(stored > 0, raw / stored).alias("ratio"),
        F.when(F.col("row_count") > 0, stored / F.col("row_count")).alias("bytes_per_record"),
        F.when(raw > 0, (1 - stored / raw) * 100).alias("saving_pct"),
    )


def _mean(value: str, condition: Column) -> Column:
    return F.coalesce(F.avg(F.when(condition, F.col(value))), F.lit(0.0))


def ops_report(log: DataFrame) -> DataFrame:
    """Counts and means per kind of operation in one row; an empty log gives zeros."""
    of = lambda kind: F.col("kind") == kind
    return log.agg(
        F.count_if(of("query")).alias("queries"),
        _mean("duration_ms", of("query")).alias("avg_query_ms"),
        F.count_if(of("ingest")).alias("ingests"),
        _mean("duration_ms", of("ingest")).alias("avg_ingest_ms"),
        F.count_if(of("compression")).alias("compressions"),
        _mean("ratio", of("compression")).alias("avg_ratio"),
    )


def query_throughput(log: DataFrame) -> DataFrame:
    """Mean chunk read, mean time per record and records per second; 0 when empty.

    ``log`` has one row per chunk read: ``read_ms``, ``filter_ms``, ``records``.
    """
    per = lambda total, n: F.when(n > 0, total / n).otherwise(F.lit(0.0))
    totals = log.agg(
        F.count("*").alias("chunks_read"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("read_ms"), F.lit(0)).cast("double").alias("read_ms"),
        F.coalesce(F.sum("filter_ms"), F.lit(0)).cast("double").alias("filter_ms"),
    )
    spent = (F.col("read_ms") + F.col("filter_ms")) / 1000.0
    return totals.select(
        "chunks_read", "total_records",
        per(F.col("read_ms"), F.col("chunks_read")).alias("avg_chunk_read_ms"),
        per(F.col("filter_ms"), F.col("total_records")).alias("avg_record_ms"),
        per(F.col("total_records"), spent).alias("records_per_sec"),
    )
