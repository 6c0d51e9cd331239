"""Aggregation queries over observations, the catalog and the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import integrity, quality, reports, stats
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.joins import catalog
from gaugeworks.plans.projections import daily_obs
from gaugeworks.plans.registry import query
from gaugeworks.plans.stored import BOTH_SQL, CATALOG_SQL, KEPT_DAILY, stored_root
from gaugeworks.schemas import RECORD_WIDTH
from gaugeworks.session import scratch
from gaugeworks.sources import dimensions, store

LOG = f"log AS (SELECT {A.FETCH_LOG} FROM events)"
OPS = f"log AS (SELECT {A.OPS_LOG} FROM events)"


_DAILY_STATS_SQL = f"""{C.daily()}
SELECT station_id, year, min(temperature) / 10.0::DOUBLE AS min_temp,
  max(temperature) / 10.0::DOUBLE AS max_temp,
  cast(sum(temperature) AS DOUBLE) / (count(*) * 10.0::DOUBLE) AS avg_temp,
  cast(sum(et) AS DOUBLE) / 100.0::DOUBLE AS total_et, count(*) AS record_count
FROM obs WHERE {C.VALID_DAILY} GROUP BY station_id, year"""


@query("daily_stats", _DAILY_STATS_SQL)
def daily_stats(spark, sf):
    daily = catalog(spark, sf).where("data_type = 'daily'")
    return stats.merged_daily_stats(daily, "station_id", "year")


@query("daily_stats_rows", _DAILY_STATS_SQL)
def daily_stats_rows(spark, sf):
    return stats.daily_stats(quality.valid(daily_obs(spark, sf), "daily"), "station_id", "year")


@query("store_stats", f"""{BOTH_SQL}
SELECT (SELECT count(*) FROM supplier) AS station_count,
  (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS active_station_count,
  count(*) AS chunk_count, cast(sum(row_count) AS BIGINT) AS total_rows,
  true AS bytes_as_listed, true AS has_ratio FROM catalog""")
def store_stats(spark, sf):
    stations = dimensions.scan_stations(A.stations_landed(spark, sf))
    found = stats.store_stats(catalog(spark, sf), stations)
    files = integrity.list_files(spark, f"{stored_root(spark, sf)}/data_type=*").agg(
        F.sum("length").alias("listed_bytes"))
    both = found.unionByName(files, allowMissingColumns=True)
    whole = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return whole.select(
        "station_count", "active_station_count", "chunk_count", "total_rows",
        (F.abs(F.col("total_bytes") - F.col("listed_bytes")) < 1).alias("bytes_as_listed"),
        (F.col("avg_ratio") > 0).alias("has_ratio"))


@query("fetch_summary", f"""WITH {LOG}
SELECT count(*) AS stations, count(*) FILTER (success) AS successful,
  count(*) FILTER (NOT success) AS failed,
  cast(sum(records) FILTER (success) AS BIGINT) AS total_records FROM log""")
def fetch_summary(spark, sf):
    return stats.fetch_summary(A.fetch_log(spark, sf))


_PHASES_SQL = ", ".join(f"CASE WHEN success THEN {p} END AS {p}" for p in stats.PHASES)


@query("fetch_timing", f"""WITH {LOG}
SELECT ordinal, station_id, success, CASE WHEN success THEN records END AS records, {_PHASES_SQL},
  CASE WHEN NOT success THEN error END AS error FROM log""")
def fetch_timing(spark, sf):
    return stats.fetch_timing(A.fetch_log(spark, sf))


@query("fetch_percentiles", f"""WITH {LOG}, ok AS (SELECT * FROM log WHERE success)
{" UNION ALL ".join(f"SELECT '{p}' AS phase, count({p}) AS fetches, true AS p50_close, true AS p99_close FROM ok"
                    for p in stats.PHASES)}""")
def fetch_percentiles(spark, sf):
    """Sketches of seven ingests are stored and merged; what they give is held against
    the exact ranks of the same values."""
    log, place = A.fetch_log(spark, sf), scratch(spark, "timing")
    per_ingest = stats.timing_sketches(log.withColumn("ingest_id", F.col("ordinal") % 7), "ingest_id")
    per_ingest.write.partitionBy("ingest_id").parquet(place)
    found = stats.merged_percentiles(spark.read.parquet(place), p50=0.5, p99=0.99)
    times = log.where("success").unpivot(["ordinal"], list(stats.PHASES), "phase", "ms")

    def close(name, rank):
        below, upto = F.count_if(F.col("ms") < F.col(name)), F.count_if(F.col("ms") <= F.col(name))
        return ((below <= (rank + stats.RANK_ERROR) * F.count("*"))
                & (upto >= (rank - stats.RANK_ERROR) * F.count("*"))).alias(f"{name}_close")

    return times.join(found, "phase").groupBy("phase", "fetches").agg(close("p50", 0.5), close("p99", 0.99))


_WIDTH_SQL = f"CASE data_type WHEN 'daily' THEN {RECORD_WIDTH['daily']} ELSE {RECORD_WIDTH['hourly']} END"


@query("storage_efficiency", f"""{BOTH_SQL}
SELECT station_id, year, data_type, row_count, row_count * {_WIDTH_SQL} AS raw_bytes,
  true AS consistent FROM catalog""")
def storage_efficiency(spark, sf):
    return efficiency_checked(catalog(spark, sf))


@query("stored_efficiency", f"""{KEPT_DAILY}, {CATALOG_SQL}
SELECT station_id, year, 'daily' AS data_type, row_count, row_count * {RECORD_WIDTH["daily"]} AS raw_bytes,
  true AS consistent FROM catalog""")
def stored_efficiency(spark, sf):
    return efficiency_checked(catalog(spark, sf).where("data_type = 'daily'"))


def efficiency_checked(recorded):
    """Sizes depend on the codec, so the three figures are held against each other."""
    ratio, width = F.col("ratio"), F.col("raw_bytes") / F.col("row_count")
    return stats.storage_efficiency(recorded).select(
        "station_id", "year", "data_type", "row_count", "raw_bytes",
        ((ratio > 0) & (F.abs(F.col("bytes_per_record") * ratio - width) < 1e-9)
         & (F.abs(F.col("saving_pct") - (1 - 1 / ratio) * 100) < 1e-6)).alias("consistent"))


def _mean_sql(value, kind):
    return f"round(coalesce(avg(CASE WHEN kind = '{kind}' THEN {value} END), 0), 6)"


@query("ops_report", f"""WITH {OPS}
SELECT count(*) FILTER (kind = 'query') AS queries,
  {_mean_sql('duration_us100::DOUBLE', 'query')} AS avg_query_ms,
  count(*) FILTER (kind = 'ingest') AS ingests,
  {_mean_sql('duration_us100::DOUBLE', 'ingest')} AS avg_ingest_ms,
  count(*) FILTER (kind = 'compression') AS compressions,
  {_mean_sql('ratio', 'compression')} AS avg_ratio FROM log""")
def ops_report(spark, sf):
    report = stats.ops_report(A.ops_log(spark, sf))
    return report.select(*(
        F.round(c, 6).alias(c) if c.startswith("avg_") else F.col(c) for c in report.columns))


@query("query_throughput", f"""WITH {OPS}, t AS (SELECT count(*) AS chunks_read,
  cast(sum(records) AS BIGINT) AS total_records, cast(sum(read_ms) AS DOUBLE) AS r,
  cast(sum(filter_ms) AS DOUBLE) AS f FROM log WHERE kind = 'query')
SELECT chunks_read, total_records, r / chunks_read AS avg_chunk_read_ms,
  f / total_records AS avg_record_ms,
  total_records / ((r + f) / 1000.0::DOUBLE) AS records_per_sec FROM t""")
def query_throughput(spark, sf):
    return stats.query_throughput(A.ops_log(spark, sf).where("kind = 'query'"))


@query("ingest_dry_run", f"{C.daily()} SELECT station_id, count(*) AS records FROM obs GROUP BY 1")
def ingest_dry_run(spark, sf):
    return reports.ingest_dry_run(daily_obs(spark, sf))


_TIMINGS_SQL = " || ',' || ".join(f"""'"{p}":' || {p}""" for p in stats.PHASES)


@query("fetch_summary_json", f"""WITH {LOG}
SELECT cast(-1 AS BIGINT) AS line,
  '{{"total_stations":' || count(*) || ',"successful":' || count(*) FILTER (success)
  || ',"failed":' || count(*) FILTER (NOT success) || ',"total_records":'
  || cast(sum(records) FILTER (success) AS BIGINT) || '}}' AS json FROM log
UNION ALL
SELECT ordinal, '{{"station_id":' || station_id || ',"year":' || year || ',"success":' || success
  || ',"records":' || records || ',"attempts":' || attempts
  || coalesce(',"error":"' || error || '"', '') || ',"timings":{{' || {_TIMINGS_SQL}
  || '}},"bytes_transferred":' || bytes_transferred || '}}' FROM log""")
def fetch_summary_json(spark, sf):
    return reports.fetch_summary_json(A.fetch_log(spark, sf))
