"""Queries that write to a fresh shared folder and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import integrity, quality, ranges, reports
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.filters import END, START, STATION
from gaugeworks.plans.projections import daily_obs, hourly_obs
from gaugeworks.plans.registry import query
from gaugeworks.plans.sequences import ORDER
from gaugeworks.plans.stored import (
    BOTH_SQL, EXTRA, GONE, INGESTS, JUNK, KEPT_DAILY, KEPT_HOURLY, OPEN, compacted_root, damaged_root, many_root,
    packed_root, stored_root,
)
from gaugeworks.schemas import DAILY_COLUMNS, HOURLY_COLUMNS
from gaugeworks.session import scratch
from gaugeworks.sources import fixedwidth, snapshots, store

_VALID_DAILY, _VALID_HOURLY = KEPT_DAILY, KEPT_HOURLY
_PER_CHUNK = """SELECT station_id, year, count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts,
  cast(sum(temperature) AS BIGINT) AS sum_temperature FROM kept GROUP BY station_id, year"""


def _per_chunk(rows):
    return rows.groupBy("station_id", "year").agg(
        F.count("*").alias("row_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.sum("temperature").alias("sum_temperature"))


@query("write_obs", f"{_VALID_DAILY} {_PER_CHUNK}")
def write_obs(spark, sf):
    root = scratch(spark, "write")
    store.write_obs(quality.valid(daily_obs(spark, sf), "daily"), root, "daily", "first")
    return _per_chunk(store.read_obs(spark, root, "daily"))


@query("write_obs_level", f"{_VALID_HOURLY} {_PER_CHUNK}")
def write_obs_level(spark, sf):
    root = scratch(spark, "level")
    store.write_obs(quality.valid(hourly_obs(spark, sf), "hourly"), root, "hourly", "first", level=9)
    return _per_chunk(store.read_obs(spark, root, "hourly"))


@query("stored_daily", f"{_VALID_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept")
def stored_daily(spark, sf):
    return snapshots.read_obs(spark, stored_root(spark, sf), "daily").select(*DAILY_COLUMNS)


@query("stored_hourly", f"{_VALID_HOURLY} SELECT {C.HOURLY_COLUMNS} FROM kept")
def stored_hourly(spark, sf):
    return snapshots.read_obs(spark, stored_root(spark, sf), "hourly").select(*HOURLY_COLUMNS)


_RANGE_SQL = f"""{_VALID_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept
WHERE station_id = {STATION} AND obs_date >= DATE '{START}' AND obs_date < DATE '{END}'"""


def _range_of(spark, root):
    obs = snapshots.read_obs(spark, root, "daily", STATION, START, END)
    return ranges.query_range(obs, "daily", STATION, START, END).select(*DAILY_COLUMNS)


@query("stored_range", _RANGE_SQL)
def stored_range(spark, sf):
    return _range_of(spark, many_root(spark, sf))


@query("compacted_range", _RANGE_SQL)
def compacted_range(spark, sf):
    return _range_of(spark, compacted_root(spark, sf))


@query("compacted_daily", f"{_VALID_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept")
def compacted_daily(spark, sf):
    return snapshots.read_obs(spark, compacted_root(spark, sf), "daily").select(*DAILY_COLUMNS)


_BOUNDS_SQL = """min(station_id) AS min_station, max(station_id) AS max_station,
  min(ts) AS min_ts, max(ts) AS max_ts"""


def _bounds(live):
    """Ingests, rows and bounds per folder of year and station group."""
    return live.groupBy("year", "station_group").agg(
        F.count_distinct("ingest_id").alias("ingests"), F.sum("row_count").alias("row_count"),
        F.min("min_station").alias("min_station"), F.max("max_station").alias("max_station"),
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


@query("manifest", f"""{_VALID_DAILY}
SELECT year, cast(station_id // {store.STATIONS_PER_GROUP} AS INTEGER) AS station_group,
  count(DISTINCT (station_id * 31 + year) % {INGESTS}) AS ingests, count(*) AS row_count, {_BOUNDS_SQL}
FROM kept GROUP BY ALL""")
def manifest(spark, sf):
    return _bounds(snapshots.files(spark, many_root(spark, sf), "daily"))


@query("compacted_files", f"""{_VALID_DAILY}
SELECT year, cast(station_id // {store.STATIONS_PER_GROUP} AS INTEGER) AS station_group,
  CASE WHEN year < {OPEN} THEN 1 ELSE count(DISTINCT (station_id * 31 + year) % {INGESTS}) END AS ingests,
  count(*) AS row_count, {_BOUNDS_SQL}
FROM kept GROUP BY year, station_id // {store.STATIONS_PER_GROUP}""")
def compacted_files(spark, sf):
    return _bounds(snapshots.files(spark, compacted_root(spark, sf), "daily"))


@query("compacted_verify", f"""{_VALID_DAILY} SELECT true AS ok, count(*) AS rows_read FROM kept""")
def compacted_verify(spark, sf):
    return integrity.verify_files(spark, compacted_root(spark, sf), "daily").groupBy("ok").agg(
        F.sum("rows_read").alias("rows_read"))


@query("chunk_catalog", f"""{BOTH_SQL}
SELECT station_id, year, data_type, row_count, min_ts, max_ts, true AS has_bytes FROM catalog""")
def chunk_catalog(spark, sf):
    return snapshots.read_catalog(spark, stored_root(spark, sf)).select(
        "station_id", "year", "data_type", "row_count", "min_ts", "max_ts",
        (F.col("stored_bytes") > 0).alias("has_bytes"))


@query("readback_diff", f"""{_VALID_DAILY} SELECT count(*) AS rows_written, count(*) AS rows_read,
  cast(0 AS BIGINT) AS only_written, cast(0 AS BIGINT) AS only_read FROM kept""")
def readback_diff(spark, sf):
    written = quality.valid(daily_obs(spark, sf), "daily").select(*DAILY_COLUMNS)
    read = snapshots.read_obs(spark, stored_root(spark, sf), "daily")
    return integrity.readback_diff(written, read)


# One station reads warmer in a month, one loses a week, and a day of another comes twice.
_WARMER = "station_id % 11 = 3 AND ts BETWEEN 4400 AND 4430"
_LOST = "station_id % 11 = 5 AND ts BETWEEN 4500 AND 4506"
_TWICE = "station_id % 11 = 7 AND ts = 4600"


@query("located_diff", f"""{_VALID_DAILY}, few AS (SELECT {C.DAILY_COLUMNS}, count(*) AS n FROM kept GROUP BY ALL)
SELECT *, 'written' AS side FROM (SELECT {C.DAILY_COLUMNS}, n AS times FROM few WHERE {_WARMER} OR {_LOST})
UNION ALL SELECT station_id, year, ts, obs_date, temperature + 10000 AS temperature, et, wind_speed, humidity,
  solar_radiation, qc_flags, n AS times, 'read' AS side FROM few WHERE {_WARMER}
UNION ALL SELECT *, 'read' FROM (SELECT {C.DAILY_COLUMNS}, n AS times FROM few WHERE {_TWICE})""")
def located_diff(spark, sf):
    written = snapshots.read_obs(spark, stored_root(spark, sf), "daily").select(*DAILY_COLUMNS)
    warmer = F.when(F.expr(_WARMER), F.col("temperature") + 10000).otherwise(F.col("temperature"))
    read = written.withColumn("temperature", warmer).where(f"NOT ({_LOST})")
    return integrity.located_diff(written, read.unionByName(written.where(_TWICE)))


@query("verify_files", f"""{_VALID_DAILY} SELECT true AS ok, count(*) AS rows_read FROM kept""")
def verify_files(spark, sf):
    return integrity.verify_files(spark, stored_root(spark, sf), "daily").groupBy("ok").agg(
        F.sum("rows_read").alias("rows_read"))


# A folder may hold any number of files, so folders are what SQL can count.
_FOLDER = r"(year=.*)/[^/]*$"
_FOLDERS_SQL = f"count(DISTINCT (year, station_id // {store.STATIONS_PER_GROUP}))"


def _folder(path):
    return F.regexp_extract(path, _FOLDER, 1)


@query("verify_summary", f"{_VALID_HOURLY} SELECT {_FOLDERS_SQL} AS verified, 0::BIGINT AS failed FROM kept")
def verify_summary(spark, sf):
    verified = integrity.verify_files(spark, stored_root(spark, sf), "hourly")
    return integrity.verify_summary(
        verified.groupBy(_folder("file")).agg(F.bool_and("ok").alias("ok")))


@query("verify_candidates", f"{_VALID_DAILY} SELECT {_FOLDERS_SQL} AS folders, true AS sized FROM kept")
def verify_candidates(spark, sf):
    listed = integrity.list_files(spark, f"{stored_root(spark, sf)}/data_type=daily")
    return listed.agg(
        F.count_distinct(_folder("path")).alias("folders"), (F.min("length") > 0).alias("sized"))


@query("nonempty_files", f"{_VALID_DAILY} SELECT true AS written, {_FOLDERS_SQL} AS folders FROM kept")
def nonempty_files(spark, sf):
    checked = integrity.nonempty_files(spark, stored_root(spark, sf), "daily")
    return checked.groupBy("written").agg(F.count_distinct(_folder("file")).alias("folders"))


_IN_FIRST_GROUP = f"station_id < {store.STATIONS_PER_GROUP}"
_FOLDER_SQL = f"concat('year=', year, '/station_group=', station_id // {store.STATIONS_PER_GROUP})"


@query("stored_skipped", f"""{_VALID_DAILY}
SELECT DISTINCT {_FOLDER_SQL} AS folder, CASE year WHEN {GONE} THEN 'file is gone'
  ELSE 'file cannot be read' END AS error FROM kept
WHERE {_IN_FIRST_GROUP} AND year IN ({GONE}, {JUNK})
UNION ALL SELECT 'year={EXTRA}/station_group=0', 'file cannot be read'""")
def stored_skipped(spark, sf):
    skipped = integrity.skipped_files(spark, damaged_root(spark, sf), "daily")
    return skipped.select(_folder("file").alias("folder"), "error").distinct()


@query("stored_tolerant", f"""{_VALID_DAILY} SELECT {C.DAILY_COLUMNS} FROM kept
WHERE NOT ({_IN_FIRST_GROUP} AND year IN ({GONE}, {JUNK}))""")
def stored_tolerant(spark, sf):
    return store.read_obs(spark, damaged_root(spark, sf), "daily", tolerant=True).select(*DAILY_COLUMNS)


@query("verify_damaged", f"""{_VALID_DAILY}, folders AS (SELECT DISTINCT {_FOLDER_SQL} AS folder,
  {_IN_FIRST_GROUP} AND year IN ({GONE}, {JUNK}, {EXTRA}) AS damaged FROM kept)
SELECT count(*) FILTER (NOT damaged) AS verified, count(*) FILTER (damaged) AS failed FROM folders""")
def verify_damaged(spark, sf):
    verified = integrity.verify_files(spark, damaged_root(spark, sf), "daily")
    return integrity.verify_summary(
        verified.groupBy(_folder("file")).agg(F.bool_and("ok").alias("ok")))


@query("nonempty_damaged", f"""{_VALID_DAILY}, folders AS (SELECT DISTINCT {_FOLDER_SQL} AS folder,
  NOT ({_IN_FIRST_GROUP} AND year = {GONE}) AS written FROM kept)
SELECT written, count(*) AS folders FROM folders GROUP BY written""")
def nonempty_damaged(spark, sf):
    checked = integrity.nonempty_files(spark, damaged_root(spark, sf), "daily")
    return checked.groupBy("written").agg(F.count_distinct(_folder("file")).alias("folders"))


@query("export_csv", f"""{_VALID_DAILY} SELECT station_id, obs_date, temperature, et FROM kept
WHERE station_id = {STATION} AND obs_date >= DATE '{START}' AND obs_date < DATE '{END}'""")
def export_csv(spark, sf):
    path = scratch(spark, "csv")
    reports.export_csv(stored_range(spark, sf).select("station_id", "obs_date", "temperature", "et"), path)
    return spark.read.csv(
        path, header=True, schema="station_id INT, obs_date DATE, temperature INT, et INT")


def _bytes_sql(fields, spare):
    """Fields lowest byte first as hex digits."""
    parts = [f"printf('%02X', ({n} >> {8 * i}) & 255)" for n, w in fields for i in range(w)]
    return " || ".join(parts) + f" || '{'00' * spare}'"


_DAILY_HEX = _bytes_sql(
    (("ts", 4), ("station_id", 2), ("temperature", 2), ("et", 2), ("wind_speed", 2),
     ("humidity", 1), ("solar_radiation", 1), ("qc_flags", 1)), 1)
_HOURLY_HEX = _bytes_sql(
    (("ts", 4), ("station_id", 2), ("temperature", 2), ("et", 2), ("wind_speed", 2),
     ("wind_direction", 1), ("humidity", 1), ("solar_radiation", 2), ("precipitation", 2),
     ("vapor_pressure", 2), ("qc_flags", 1)), 3)
_FITS = "solar_radiation <= 255 AND humidity <= 255"


@query("pack_daily", f"""{C.daily()} SELECT {C.DAILY_COLUMNS},
  CASE WHEN {_FITS} THEN {_DAILY_HEX} END AS record FROM obs""")
def pack_daily(spark, sf):
    packed = fixedwidth.pack(daily_obs(spark, sf), "daily")
    return packed.select(*DAILY_COLUMNS, F.hex("record").alias("record"))


_MISFIT = " ".join(
    f"WHEN NOT coalesce({name} BETWEEN {low} AND {high}, false) THEN '{name}'"
    for name, (low, high) in ((n, fixedwidth.bounds(w, s)) for n, w, s in fixedwidth.LAYOUT["daily"]))


@query("pack_rejects", f"""{C.daily()}
SELECT {C.DAILY_COLUMNS}, CASE {_MISFIT} END AS field FROM obs WHERE CASE {_MISFIT} END IS NOT NULL""")
def pack_rejects(spark, sf):
    return fixedwidth.rejects(daily_obs(spark, sf), "daily").select(*DAILY_COLUMNS, "field")


@query("pack_hourly", f"{C.hourly()} SELECT {C.HOURLY_COLUMNS}, {_HOURLY_HEX} AS record FROM obs")
def pack_hourly(spark, sf):
    packed = fixedwidth.pack(hourly_obs(spark, sf), "hourly")
    return packed.select(*HOURLY_COLUMNS, F.hex("record").alias("record"))


def _payloads(obs, kind, order):
    """Packed blocks with half a record behind them, which an import has to ignore."""
    blocks = fixedwidth.pack_blocks(obs, kind, order, rows=100)
    return blocks.select("block", F.concat("content", F.unhex(F.lit("FF" * 7))).alias("content"))


@query("unpack_blocks", f"{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs WHERE {_FITS}")
def unpack_blocks(spark, sf):
    payloads = _payloads(daily_obs(spark, sf), "daily", list(ORDER))
    rows = fixedwidth.with_time(fixedwidth.unpack(payloads, "daily"), "daily")
    return rows.withColumn("ts", F.col("ts").cast("int")).select(*DAILY_COLUMNS)


@query("unpack_daily", f"{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs WHERE {_FITS}")
def unpack_daily(spark, sf):
    return fixedwidth.read_packed(spark, packed_root(spark, sf, "daily"), "daily").select(*DAILY_COLUMNS)


@query("unpack_hourly", f"{C.hourly()} SELECT {C.HOURLY_COLUMNS} FROM obs")
def unpack_hourly(spark, sf):
    return fixedwidth.read_packed(spark, packed_root(spark, sf, "hourly"), "hourly").select(*HOURLY_COLUMNS)


@query("unpack_range", f"""{C.daily()} SELECT {C.DAILY_COLUMNS} FROM obs WHERE {_FITS}
AND station_id = {STATION} AND obs_date >= DATE '{START}' AND obs_date < DATE '{END}'""")
def unpack_range(spark, sf):
    rows = fixedwidth.read_packed(spark, packed_root(spark, sf, "daily"), "daily", STATION, START, END)
    return rows.select(*DAILY_COLUMNS)


@query("packed_index", f"""{C.daily()} SELECT year, cast(station_id // {store.STATIONS_PER_GROUP} AS INTEGER) AS station_group,
  count(*) AS row_count, min(station_id) AS min_station, max(station_id) AS max_station,
  cast(min(ts) AS BIGINT) AS min_ts, cast(max(ts) AS BIGINT) AS max_ts
FROM obs WHERE {_FITS} GROUP BY year, station_id // {store.STATIONS_PER_GROUP}""")
def packed_index(spark, sf):
    return fixedwidth.read_index(spark, packed_root(spark, sf, "daily"))


@query("packed_rejects", f"""{C.daily()}
SELECT {C.DAILY_COLUMNS}, CASE {_MISFIT} END AS field FROM obs WHERE CASE {_MISFIT} END IS NOT NULL""")
def packed_rejects(spark, sf):
    return fixedwidth.read_rejects(spark, packed_root(spark, sf, "daily")).select(*DAILY_COLUMNS, "field")
