"""Range, validity and catalog filters, previews and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import measures
from gaugeworks.operators import convert, integrity, quality, ranges
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.joins import catalog
from gaugeworks.plans.registry import query
from gaugeworks.plans.stored import CATALOG_SQL, KEPT_DAILY, KEPT_HOURLY, stored_root
from gaugeworks.schemas import DAILY_COLUMNS, HOURLY_COLUMNS
from gaugeworks.sources import snapshots

STATION, START, END = 5, "1996-03-01", "1998-07-01"
_DAILY_RANGE = f"station_id = {STATION} AND obs_date >= DATE '{START}' AND obs_date < DATE '{END}'"
_HOURLY_RANGE = "station_id = 7 AND obs_ts >= TIMESTAMP '2024-01-05' AND obs_ts < TIMESTAMP '2024-01-20'"
_TIES = ("ts", "temperature", "et", "wind_speed", "humidity", "solar_radiation", "qc_flags")


def _daily_range(spark, sf):
    stored = snapshots.read_obs(spark, stored_root(spark, sf), "daily", STATION, START, END)
    return ranges.query_range(stored, "daily", STATION, START, END).select(*DAILY_COLUMNS)


@query("query_daily_range", f"{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs WHERE {_DAILY_RANGE}")
def query_daily_range(spark, sf):
    """Of all converted rows, valid or not; the store holds valid ones only."""
    obs = convert.convert_daily(A.daily_raw(spark, sf))
    return ranges.query_range(obs, "daily", STATION, START, END).select(*DAILY_COLUMNS)


@query("query_hourly_range", f"{KEPT_HOURLY} SELECT {C.HOURLY_COLUMNS} FROM kept WHERE {_HOURLY_RANGE}")
def query_hourly_range(spark, sf):
    span = (7, "2024-01-05", "2024-01-20")
    stored = snapshots.read_obs(spark, stored_root(spark, sf), "hourly", *span)
    return ranges.query_range(stored, "hourly", *span).select(*HOURLY_COLUMNS)


@query("query_preview",
       f"{KEPT_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept WHERE {_DAILY_RANGE} "
       f"ORDER BY {', '.join(_TIES)} LIMIT 10")
def query_preview(spark, sf):
    return ranges.preview(_daily_range(spark, sf), *_TIES)


@query("query_count", f"{KEPT_DAILY} SELECT count(*) AS total_records FROM kept WHERE {_DAILY_RANGE}")
def query_count(spark, sf):
    return ranges.query_count(_daily_range(spark, sf))


@query("recent_days", f"""{KEPT_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept
WHERE obs_date >= DATE '2001-11-04' - 30 AND obs_date < DATE '2001-11-04'""")
def recent_days(spark, sf):
    stored = snapshots.read_obs(
        spark, stored_root(spark, sf), "daily", start=ranges.days_before("2001-11-04", 30), end="2001-11-04")
    return ranges.recent_days(stored, "daily", "2001-11-04", 30).select(*DAILY_COLUMNS)


@query("chunk_select", f"""{KEPT_DAILY}, {CATALOG_SQL}
SELECT station_id, year, 'daily' AS data_type, row_count FROM catalog
WHERE station_id = {STATION} AND year BETWEEN 1996 AND 1998""")
def chunk_select(spark, sf):
    return ranges.chunk_select(catalog(spark, sf), STATION, 1996, 1998, "daily").select(
        "station_id", "year", "data_type", "row_count")


@query("valid_daily", f"{C.daily(C.lenient_date)} SELECT {C.DAILY_COLUMNS} FROM obs WHERE {C.VALID_DAILY}")
def valid_daily(spark, sf):
    return quality.valid(convert.convert_daily_lenient(A.daily_raw(spark, sf)), "daily")


@query("invalid_daily",
       f"{C.daily(C.lenient_date)} SELECT {C.DAILY_COLUMNS} FROM obs WHERE NOT {C.VALID_DAILY}")
def invalid_daily(spark, sf):
    return quality.invalid(convert.convert_daily_lenient(A.daily_raw(spark, sf)), "daily")


@query("valid_hourly", f"{C.hourly()} SELECT {C.HOURLY_COLUMNS} FROM obs WHERE {C.VALID_HOURLY}")
def valid_hourly(spark, sf):
    return quality.valid(convert.convert_hourly(A.hourly_raw(spark, sf)), "hourly")


@query("qc_flagged", f"""WITH {C.RAW_DAILY}
SELECT src_order, src_line, src_part, {C.flagged('tmp_v', 'tmp_q')} AS temperature_flagged,
  {C.flagged('eto_v', 'eto_q')} AS et_flagged FROM raw""")
def qc_flagged(spark, sf):
    return A.daily_raw(spark, sf).select(
        *A.DAILY_KEYS,
        measures.qc_flagged(F.col("DayAirTmpAvg")).alias("temperature_flagged"),
        measures.qc_flagged(F.col("DayAsceEto")).alias("et_flagged"))


@query("drop_bad_dates", f"""WITH {C.RAW_DAILY}, dated AS (SELECT *, {C.iso_date('day_text')} AS d FROM raw)
SELECT station_id, src_order, src_line, src_part, day_text AS "Date",
  cast(d - {C.EPOCH} AS INTEGER) AS ts FROM dated WHERE d >= {C.EPOCH}""")
def drop_bad_dates(spark, sf):
    return convert.drop_bad_dates(A.daily_raw(spark, sf)).select(
        "station_id", *A.DAILY_KEYS, "Date", "ts")


@query("drop_nonpositive_ts", f"{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs WHERE ts > 0")
def drop_nonpositive_ts(spark, sf):
    return convert.drop_nonpositive_ts(convert.convert_daily(A.daily_raw(spark, sf)))


@query("batch_ordered", """WITH requests AS (SELECT c_custkey AS ordinal,
  cast(c_custkey % 200 AS INTEGER) AS station_id FROM customer)
SELECT ordinal, station_id, cast(row_number() OVER (ORDER BY ordinal) - 1 AS BIGINT) AS place
FROM requests""")
def batch_ordered(spark, sf):
    from gaugeworks.plans.scans import batch_requests

    return ranges.in_request_order(ranges.placed(batch_requests(spark, sf), "ordinal"))


@query("union_stations", f"""{C.daily()}
SELECT {C.DAILY_COLUMNS} FROM obs WHERE qc_flags = 0
UNION ALL SELECT {C.DAILY_COLUMNS} FROM obs WHERE temperature > 300
UNION ALL SELECT {C.DAILY_COLUMNS} FROM obs WHERE humidity > 100""")
def union_stations(spark, sf):
    obs = convert.convert_daily(A.daily_raw(spark, sf))
    return integrity.union_stations(
        obs.where("qc_flags = 0"), obs.where("temperature > 300"), obs.where("humidity > 100"))
