"""The given tables in the shapes the operators read.

``lineitem`` plays daily readings, ``events`` hourly readings and the job logs,
``supplier`` the stations.  The select lists are plain SQL that both engines
read alike, so that the checking SQL starts from the same texts.  They hold
malformed dates, numbers and bodies on purpose.  Every adapter is row-local or
an ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.functions.texts import RETRYABLE_TEXTS
from gaugeworks.schemas import DAILY_MEASURES, HOURLY_MEASURES
from gaugeworks.session import scratch
from gaugeworks.sources import responses

_SHIPPED = "cast(l_shipdate AS string)"
_TS = "cast(ts AS string)"

# A page holds the readings of one station, month and half of an order's lines,
# out of so many orders; this bounds it however busy the station is.
ORDERS_PER_PAGE = 100_000
# A page of hourly readings holds those of one station and month, out of so many.
EVENTS_PER_PAGE = 50_000
_HALF = "CASE WHEN l_linenumber <= 4 THEN 'a' ELSE 'b' END"
_ASKED = f"concat('-', cast(cast(l_suppkey AS int) AS string), '-', substr({_SHIPPED}, 1, 4))"
_PAGE_NUMBER = (
    f"(cast(substr({_SHIPPED}, 1, 4) AS int) * 12 + cast(substr({_SHIPPED}, 6, 2) AS int)"
    " + cast(l_suppkey AS int) + CASE WHEN l_linenumber <= 4 THEN 0 ELSE 5 END)"
)

DAILY = f"""
  cast(l_suppkey AS int) AS station_id,
  l_orderkey AS src_order, l_linenumber AS src_line, l_partkey AS src_part,
  CASE l_orderkey % 101
    WHEN 0 THEN 'bad-date'
    WHEN 1 THEN concat(substr({_SHIPPED}, 1, 4), '-02-30')
    WHEN 2 THEN concat(substr({_SHIPPED}, 6, 2), '/', substr({_SHIPPED}, 9, 2), '/', substr({_SHIPPED}, 1, 4))
    WHEN 3 THEN '1985-01-01'
    WHEN 4 THEN '1979-06-01'
    WHEN 5 THEN '2101-01-02'
    ELSE substr({_SHIPPED}, 1, 10) END AS day_text,
  CASE WHEN l_orderkey % 53 = 0 AND l_suppkey % 5 = 1 THEN ''
    WHEN l_orderkey % 53 = 1 AND l_suppkey % 5 = 1 THEN 'abc'
    WHEN l_orderkey % 53 = 2 AND l_suppkey % 5 = 1 THEN ' 5'
    WHEN l_orderkey % 53 = 3 THEN '1e1'
    WHEN l_orderkey % 53 = 4 THEN NULL
    ELSE cast(cast(cast(l_quantity AS decimal(10,2)) * 1.7 - 20 AS decimal(10,2)) AS string) END AS tmp_v,
  CASE l_returnflag WHEN 'A' THEN ' ' WHEN 'N' THEN '' ELSE 'R' END AS tmp_q,
  cast(cast(cast(l_discount AS decimal(10,2)) * 61 AS decimal(10,2)) AS string) AS eto_v,
  CASE WHEN l_linenumber = 7 THEN 'Y' ELSE ' ' END AS eto_q,
  cast(cast(cast(l_tax AS decimal(10,2)) * 113 AS decimal(10,2)) AS string) AS wnd_v,
  cast(l_partkey % 120 AS string) AS hum_v,
  cast(cast(l_linenumber * 4.5 AS decimal(10,2)) AS string) AS sol_v,
  lpad(cast(l_suppkey % 97 AS string), 5, '0') AS zip,
  concat('lat=', cast(30 + l_suppkey % 10 AS string), '.25,lng=-', cast(110 + l_suppkey % 7 AS string), '.5') AS coord,
  concat(cast(100 + l_suppkey % 50 AS string), ' Main Street') AS addr,
  CASE WHEN l_linenumber % 2 = 1 THEN 'station' ELSE 'spatial' END AS kind,
  {_HALF} AS half, {_ASKED} AS asked,
  concat({_HALF}, {_ASKED}, substr({_SHIPPED}, 5, 3), '-',
    cast(cast(floor(l_orderkey / {ORDERS_PER_PAGE}) AS int) AS string)) AS page,
  CASE WHEN l_suppkey % 5 <> 0 THEN NULL
    WHEN {_PAGE_NUMBER} % 29 = 0 THEN 'truncated'
    WHEN {_PAGE_NUMBER} % 29 = 1 THEN 'no providers'
    WHEN {_PAGE_NUMBER} % 29 = 2 THEN 'failed' END AS fault
"""

_HH = f"substr({_TS}, 12, 2)"
_K = "cast(regexp_extract(props, '[0-9]+', 0) AS int)"

HOURLY = f"""
  cast(user_id AS int) AS station_id, event_id AS src_event,
  CASE event_id % 103
    WHEN 0 THEN 'bad-date'
    WHEN 1 THEN '2024-02-31'
    WHEN 2 THEN '1985-01-01'
    WHEN 3 THEN '1979-06-01'
    ELSE substr({_TS}, 1, 10) END AS day_text,
  CASE WHEN event_id % 89 = 0 THEN '1'
    WHEN event_id % 89 = 1 THEN 'ab:00'
    WHEN event_id % 89 = 2 THEN '+5:00'
    WHEN event_id % 3 = 0 THEN concat({_HH}, ':00')
    WHEN event_id % 3 = 1 THEN concat({_HH}, '00')
    ELSE concat(lpad(cast(cast({_HH} AS int) + 1 AS string), 2, '0'), '00') END AS hour_text,
  cast(cast(cast(value AS decimal(10,2)) * 0.1 AS decimal(10,3)) AS string) AS tmp_v,
  CASE WHEN event_type = 'error' THEN 'R' ELSE ' ' END AS tmp_q,
  cast(cast({_K} * 0.013 AS decimal(10,3)) AS string) AS eto_v,
  cast(cast(cast(value AS decimal(10,2)) * 0.03 AS decimal(10,4)) AS string) AS wnd_v,
  cast(event_id % 361 AS string) AS dir_v,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE cast({_K} + event_id % 5 AS string) END AS hum_v,
  cast(event_id % 1100 AS string) AS sol_v,
  cast(cast((event_id % 50) * 0.01 AS decimal(10,2)) AS string) AS pre_v,
  cast(cast({_K} * 0.04 AS decimal(10,2)) AS string) AS vap_v,
  lpad(cast(user_id % 97 AS string), 5, '0') AS zip,
  CASE WHEN event_id % 2 = 1 THEN 'station' ELSE 'spatial' END AS kind,
  concat(cast(cast(user_id AS int) AS string), '-', substr({_TS}, 1, 7), '-',
    cast(cast(floor(event_id / {EVENTS_PER_PAGE}) AS int) AS string)) AS page,
  CASE WHEN user_id % 13 = 4 THEN 'truncated' WHEN user_id % 13 = 6 THEN 'no providers' END AS fault
"""

STATIONS = """
  cast(s_suppkey AS int) AS station_id, s_name AS name,
  CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END AS active,
  lpad(cast(s_nationkey AS string), 5, '0') AS zip_a,
  lpad(cast(s_suppkey % 97 AS string), 5, '0') AS zip_b
"""

FETCH_LOG = f"""
  event_id AS ordinal, cast(user_id AS int) AS station_id, 2024 AS year,
  event_type <> 'error' AS success,
  {_K} AS records, cast(1 + event_id % 4 AS int) AS attempts,
  CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 429
    WHEN 4 THEN 500 WHEN 5 THEN 503 ELSE 0 END AS status_code,
  CASE WHEN event_type = 'error' THEN
    CASE event_id % 8 {" ".join(f"WHEN {i} THEN 'request: {t}'" for i, t in enumerate(RETRYABLE_TEXTS))}
      ELSE 'request: gave up' END END AS error,
  event_id % 11 AS dns_ms, event_id % 13 AS tcp_ms, event_id % 17 AS tls_ms,
  event_id % 101 AS ttfb_ms, event_id % 7 AS read_ms, event_id % 23 AS decode_ms,
  event_id % 5 AS write_ms, event_id % 997 AS total_ms,
  event_id * 37 AS bytes_transferred
"""

OPS_LOG = """
  CASE event_type WHEN 'view' THEN 'query' WHEN 'purchase' THEN 'ingest'
    WHEN 'signup' THEN 'compression' ELSE 'other' END AS kind,
  cast(floor(value * 100) AS bigint) AS duration_us100, cast(event_id % 64 AS double) / 16 AS ratio,
  cast(event_id % 61 AS int) AS read_ms, cast(event_id % 19 AS int) AS filter_ms,
  cast(event_id % 367 AS int) AS records
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Rows that a scan task may hold beyond its share before they are dealt out, and the keys by which.
ROWS_PER_TASK = 1_000_000
_DEALT_BY = {"lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",)}

_CROWDED: dict[tuple[str, str, str], bool] = {}


def _is_crowded(spark: SparkSession, sf: str, name: str) -> bool:
    """Whether few scan tasks hold most rows of a table.  A row group is never split, so
    that a file written as one is a single task however many cores there are; the counts
    come from the footers alone, once per session and table."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CROWDED:
        tasks = table(spark, sf, name).groupBy(F.spark_partition_id().alias("task")).count()
        most, rows = tasks.agg(F.max("count"), F.sum("count")).first()
        share = (rows or 0) / spark.sparkContext.defaultParallelism
        _CROWDED[key] = (most or 0) > max(ROWS_PER_TASK, 2 * share)
    return _CROWDED[key]


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are dealt out where few scan tasks would hold most of them; only
    the columns that a query reads are shuffled."""
    source = table(spark, sf, name)
    if name in _DEALT_BY and _is_crowded(spark, sf, name):
        return source.repartition(*_DEALT_BY[name])
    return source


def _shaped(spark: SparkSession, sf: str, name: str, columns: str, **shared: str) -> DataFrame:
    """The select list over a table; expressions of it that are ``shared`` by many of its
    columns are computed once a row."""
    source = spread(spark, sf, name)
    for alias, expression in shared.items():
        source = source.withColumn(alias, F.expr(expression))
        columns = columns.replace(expression, alias)
    return spark.sql(f"SELECT {columns} FROM {{source}}", source=source)


_LANDED: dict[tuple[str, str, str], str] = {}


def _land(name, build, codec="zstd"):
    """Write the landed rows once per session and table folder, then scan the copy.

    Scans read files in practice, and a body that is both built and parsed in
    one plan would be optimized away.
    """
    def landed(spark: SparkSession, sf: str) -> DataFrame:
        return spark.read.parquet(landed_path(spark, sf, name, build, codec))

    landed.__doc__ = build.__doc__
    return landed


def landed_path(spark: SparkSession, sf: str, name: str, build, codec: str = "zstd") -> str:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _LANDED:
        path = scratch(spark, f"landed-{name}")
        # Row groups small enough that a scan of the copy is many tasks.
        build(spark, sf).write.option("compression", codec).option(
            "parquet.block.size", 2 << 20).parquet(path)
        _LANDED[key] = path
    return _LANDED[key]


def daily_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily readings as texts, one row each; a query computes only those it reads."""
    return _shaped(spark, sf, "lineitem", DAILY, _shipped=_SHIPPED)


def hourly_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly readings as texts, one row each."""
    return _shaped(spark, sf, "events", HOURLY, _at=_TS, _number=_K)


def _measure(value: str, qc: str | None = None, at=F.col):
    code = at(qc) if qc else F.lit(" ")
    return F.when(
        at(value).isNotNull(),
        F.struct(at(value).alias("Value"), code.alias("Qc"), F.lit("(M)").alias("Unit")),
    )


def _absent():
    return F.lit(None).cast("struct<Value: string, Qc: string, Unit: string>")


_DAILY_TEXTS = ("day_text", "zip", "coord", "addr", "tmp_v", "tmp_q", "eto_v", "eto_q", "wnd_v", "hum_v", "sol_v")


def _daily_fields(at=F.col):
    """Fields of a record, from the texts that ``at`` gives by their names."""
    m = {
        "DayAirTmpAvg": _measure("tmp_v", "tmp_q", at), "DayAsceEto": _measure("eto_v", "eto_q", at),
        "DayWindSpdAvg": _measure("wnd_v", at=at), "DayRelHumAvg": _measure("hum_v", at=at),
        "DaySolRadAvg": _measure("sol_v", at=at), "DayPrecip": _absent(),
    }
    return [
        at("day_text").alias("Date"), F.lit("").alias("Julian"),
        F.col("station_id").cast("string").alias("Station"),
        F.lit("english").alias("Standard"), at("zip").alias("ZipCodes"),
        at("coord").alias("Coordinate"), at("addr").alias("Address"),
        F.lit("daily").alias("Scope"),
        *(m[name].alias(name) for name in DAILY_MEASURES),
    ]


def _hourly_fields():
    texts = dict(zip(HOURLY_MEASURES, (
        _measure("tmp_v", "tmp_q"), _measure("eto_v"), _measure("wnd_v"), _measure("dir_v"),
        _measure("hum_v"), _measure("sol_v"), _measure("pre_v"), _measure("vap_v"))))
    return [
        F.col("day_text").alias("Date"), F.col("hour_text").alias("Hour"),
        F.lit("").alias("Julian"), F.col("station_id").cast("string").alias("Station"),
        F.lit("english").alias("Standard"), F.col("zip").alias("ZipCodes"),
        F.lit("hourly").alias("Scope"),
        *(texts[name].alias(name) for name in HOURLY_MEASURES),
    ]


DAILY_KEYS = ("src_order", "src_line", "src_part")


def daily_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Daily records as the scans deliver them, with the keys that break ties."""
    return daily_texts(spark, sf).select("station_id", *DAILY_KEYS, *_daily_fields())


def hourly_raw(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_texts(spark, sf).select("station_id", "src_event", *_hourly_fields())


def _body(first, second):
    """A response body of a station provider and a spatial one with these records."""
    provider = lambda name, kind, rows: F.struct(
        F.lit(name).alias("Name"), F.lit(kind).alias("Type"), F.lit("owner").alias("Owner"),
        rows.alias("Records"))
    providers = F.array(
        provider("first", "station", first), provider("second", "spatial", second))
    return F.to_json(F.struct(F.struct(providers.alias("Providers")).alias("Data")))


def build_daily_landed(spark: SparkSession, sf: str) -> DataFrame:
    """One landed response line per page, with the records of both providers.

    A request has many bounded pages: gathering all readings of a station into
    one body would put a busy station in one task.
    """
    # Only the texts are shuffled; what every record repeats is added to whole pages.
    value = F.col("tmp_v")
    pages = (
        daily_texts(spark, sf)
        .withColumn("texts", F.struct(*_DAILY_TEXTS))
        .groupBy("page", "half", "asked", "station_id", "fault")
        .agg(
            F.collect_list(F.when(F.col("kind") == "station", F.col("texts"))).alias("first"),
            F.collect_list(F.when(F.col("kind") == "spatial", F.col("texts"))).alias("second"),
            F.bool_or(value.isNotNull() & value.isin("", "abc", " 5")).alias("unreadable"),
        )
    )
    records = lambda texts: F.transform(texts, lambda t: F.struct(*_daily_fields(lambda name: t[name])))
    fault = F.col("fault")
    half = F.when(fault.isNotNull() | F.col("unreadable"), "x").otherwise(F.col("half"))
    return pages.select(
        F.concat(half, "asked").alias("request_id"),
        F.when(half == "x", 0).when(half == "a", 1).otherwise(2).cast("bigint").alias("landed_seq"),
        "station_id",
        F.when(fault == "failed", "status 502").alias("error"),
        F.when(fault == "failed", F.lit(None).cast("string"))
        .when(fault == "truncated", F.lit(_CUT_OFF))
        .when(fault == "no providers", F.lit('{"Data":{}}'))
        .otherwise(_body(records(F.col("first")), records(F.col("second")))).alias("body"),
    )


_CUT_OFF = '{"Data":{"Providers":[{"Name":'


def build_hourly_landed(spark: SparkSession, sf: str) -> DataFrame:
    """One landed response line per page, with the records of both providers."""
    record = F.struct(*_hourly_fields())
    pages = (
        hourly_texts(spark, sf)
        .withColumn("record", record)
        .groupBy("page", "station_id", "fault")
        .agg(
            F.collect_list(F.when(F.col("kind") == "station", F.col("record"))).alias("first"),
            F.collect_list(F.when(F.col("kind") == "spatial", F.col("record"))).alias("second"),
            F.min("src_event").alias("landed_seq"),
        )
    )
    return pages.select(
        F.col("page").alias("request_id"), "landed_seq", "station_id",
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("fault") == "truncated", F.lit(_CUT_OFF))
        .when(F.col("fault") == "no providers", F.lit('{"Data":{}}'))
        .otherwise(_body(F.col("first"), F.col("second"))).alias("body"),
    )


def _parsed(build):
    """Bodies are parsed when they land, and scanned as variants."""
    def built(spark: SparkSession, sf: str) -> DataFrame:
        return responses.parsed(build(spark, sf))

    built.__doc__ = build.__doc__
    return built


daily_landed = _land("daily", _parsed(build_daily_landed))
# The same bodies as texts, which a scan parses for itself: parsing, checking and storing them
# as variants takes as much as several scans of the texts.  The zstd decoder holds up the
# garbage collector; among the large buffers of long texts a read has failed of that.
daily_bodies = _land("daily-bodies", build_daily_landed, "snappy")
hourly_landed = _land("hourly", _parsed(build_hourly_landed))


def station_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf, "supplier", STATIONS)


def build_stations_landed(spark: SparkSession, sf: str) -> DataFrame:
    """One landed station body per station."""
    station = F.struct(
        F.col("station_id").cast("string").alias("StationNbr"), F.col("name").alias("Name"),
        F.col("active").alias("IsActive"), F.array("zip_a", "zip_b").alias("ZipCodes"),
    )
    return station_texts(spark, sf).select(
        F.to_json(F.struct(F.array(station).alias("Stations"))).alias("body"))


def _build_zips(spark: SparkSession, sf: str, spatial: bool) -> DataFrame:
    """One landed zip body per station; spatial zips name no station."""
    entry = [F.col("zip_b").alias("ZipCode"), F.col("active").alias("IsActive")]
    if not spatial:
        entry.insert(0, F.col("station_id").alias("StationNbr"))
    return station_texts(spark, sf).select(
        F.to_json(F.struct(F.array(F.struct(*entry)).alias("ZipCodes"))).alias("body"))


stations_landed = _land("stations", build_stations_landed)
station_zips_landed = _land("station-zips", lambda spark, sf: _build_zips(spark, sf, False))
spatial_zips_landed = _land("spatial-zips", lambda spark, sf: _build_zips(spark, sf, True))


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf, "events", FETCH_LOG)


def ops_log(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf, "events", OPS_LOG).withColumn(
        "duration_ms", F.col("duration_us100").cast("double"))
