"""Conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import measures
from gaugeworks.operators import convert
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.registry import query
from gaugeworks.sources import responses

_STRICT_OK = "reject IS NULL"


def daily_obs(spark, sf):
    """Converted daily rows with the keys that break ties."""
    return convert.convert_daily(A.daily_raw(spark, sf), A.DAILY_KEYS)


def hourly_obs(spark, sf):
    return convert.convert_hourly(A.hourly_raw(spark, sf), ("src_event",))


def strict_daily(spark, sf):
    """Records of responses that the strict scan accepts."""
    return responses.scan_daily_strict(A.daily_bodies(spark, sf))


@query("convert_daily", f"{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs")
def convert_daily(spark, sf):
    return convert.convert_daily(A.daily_raw(spark, sf))


@query("convert_hourly", f"{C.hourly()} SELECT {C.HOURLY_COLUMNS} FROM obs")
def convert_hourly(spark, sf):
    return convert.convert_hourly(A.hourly_raw(spark, sf))


@query("convert_daily_lenient", f"{C.daily(C.lenient_date)} SELECT {C.DAILY_COLUMNS} FROM obs")
def convert_daily_lenient(spark, sf):
    return convert.convert_daily_lenient(A.daily_raw(spark, sf))


@query("convert_hourly_lenient", f"{C.hourly(C.lenient_date)} SELECT {C.HOURLY_COLUMNS} FROM obs")
def convert_hourly_lenient(spark, sf):
    return convert.convert_hourly_lenient(A.hourly_raw(spark, sf))


@query("convert_daily_minimal",
       f"{C.daily(C.lenient_date, where=_STRICT_OK)} SELECT {C.DAILY_COLUMNS} FROM obs")
def convert_daily_minimal(spark, sf):
    return convert.convert_daily_minimal(convert.minimal(strict_daily(spark, sf)))


@query("convert_daily_strict",
       f"{C.daily(C.lenient_date, where=_STRICT_OK)} SELECT {C.DAILY_COLUMNS} FROM obs WHERE ts > 0")
def convert_daily_strict(spark, sf):
    return convert.convert_daily_strict(convert.minimal(strict_daily(spark, sf)))


@query("format_measure", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text AS "Date",
  CASE WHEN tmp_v IS NOT NULL THEN printf('%.2f', cast(tmp_v AS DOUBLE)) END AS value_text,
  CASE WHEN tmp_v IS NOT NULL THEN tmp_q END AS qc,
  CASE WHEN tmp_v IS NOT NULL THEN '' END AS unit
FROM raw WHERE {_STRICT_OK}""")
def format_measure(spark, sf):
    m = F.col("DayAirTmpAvg")
    text = measures.format_measure(m["Value"], m["Qc"])
    return convert.minimal(strict_daily(spark, sf)).select(
        "station_id", "Date", text["Value"].alias("value_text"), text["Qc"].alias("qc"),
        text["Unit"].alias("unit"))


def _over(column, factor):
    return f"cast({column} AS DOUBLE) / cast({factor} AS DOUBLE) AS {column}"


@query("decode_daily", f"""{C.daily()} SELECT station_id, year, ts, obs_date,
  {_over('temperature', 10)}, {_over('et', 100)}, {_over('wind_speed', 10)}, humidity,
  {_over('solar_radiation', 10)}, qc_flags FROM obs""")
def decode_daily(spark, sf):
    return convert.decode(daily_obs(spark, sf), "daily")


@query("decode_hourly", f"""{C.hourly()} SELECT station_id, year, ts, obs_ts,
  {_over('temperature', 10)}, {_over('et', 1000)}, {_over('wind_speed', 10)},
  cast(wind_direction * 2 AS DOUBLE) AS wind_direction, humidity, solar_radiation,
  {_over('precipitation', 100)}, {_over('vapor_pressure', 100)}, qc_flags FROM obs""")
def decode_hourly(spark, sf):
    return convert.decode(hourly_obs(spark, sf), "hourly")
