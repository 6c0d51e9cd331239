"""One query per scalar rule, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import dates, measures, texts
from gaugeworks.operators import ranges, reports
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.aggregates import LOG
from gaugeworks.plans.registry import query
from gaugeworks.schemas import QC_BITS, SCALES

_KEYS = "src_order, src_line, src_part"
_TEXTS = f"WITH {C.RAW_DAILY} SELECT {_KEYS}, day_text,"


def _days(spark, sf, **columns):
    return A.daily_texts(spark, sf).select(
        *A.DAILY_KEYS, "day_text", *(c.alias(n) for n, c in columns.items()))


_PARSED = f"coalesce({C.iso_date('day_text')}, {C.us_date('day_text')})"


@query("parse_date", f"{_TEXTS} {_PARSED} AS parsed FROM raw")
def parse_date(spark, sf):
    return _days(spark, sf, parsed=dates.parse_date(F.col("day_text")))


@query("format_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS formatted FROM orders""")
def format_date(spark, sf):
    return A.table(spark, sf, "orders").select(
        "o_orderkey", dates.format_date(F.col("o_orderdate").cast("date")).alias("formatted"))


@query("normalize_date",
       f"{_TEXTS} coalesce(strftime({_PARSED}, '%Y-%m-%d'), day_text) AS normalized FROM raw")
def normalize_date(spark, sf):
    return _days(spark, sf, normalized=dates.normalize_date(F.col("day_text")))


_LENIENT_OK = (
    r"(regexp_full_match(day_text, '\d{4}-\d{2}-\d{2}') AND "
    "try_cast(substr(day_text, 1, 4) AS INTEGER) BETWEEN 1985 AND 2100)"
)


@query("lenient_date", f"""{_TEXTS}
  CASE WHEN {_LENIENT_OK} THEN try_cast(substr(day_text, 1, 4) AS INTEGER) END AS y,
  CASE WHEN {_LENIENT_OK} THEN try_cast(substr(day_text, 6, 2) AS INTEGER) END AS m,
  CASE WHEN {_LENIENT_OK} THEN try_cast(substr(day_text, 9, 2) AS INTEGER) END AS d,
  {C.lenient_date('day_text')} AS parsed FROM raw""")
def lenient_date(spark, sf):
    text = F.col("day_text")
    parts = dates.lenient_parts(text)
    return _days(spark, sf, y=parts["y"], m=parts["m"], d=parts["d"], parsed=dates.lenient_date(text))


@query("days_since_epoch",
       f"SELECT o_orderkey, cast(cast(o_orderdate AS DATE) - {C.EPOCH} AS INTEGER) AS days FROM orders")
def days_since_epoch(spark, sf):
    return A.table(spark, sf, "orders").select(
        "o_orderkey", dates.days_since_epoch(F.col("o_orderdate").cast("date")).alias("days"))


@query("days_to_date", f"""WITH n AS (SELECT o_orderkey,
  cast({C.EPOCH} + cast(o_orderkey % 40000 AS INTEGER) AS DATE) AS day FROM orders)
SELECT o_orderkey, day, cast(year(day) AS INTEGER) AS y, cast(month(day) AS INTEGER) AS m,
  cast(day(day) AS INTEGER) AS d FROM n""")
def days_to_date(spark, sf):
    day = dates.days_to_date((F.col("o_orderkey") % 40000).cast("int"))
    return A.table(spark, sf, "orders").select("o_orderkey", day.alias("day")).select(
        "o_orderkey", "day", F.year("day").alias("y"), F.month("day").alias("m"),
        F.dayofmonth("day").alias("d"))


@query("hours_since_epoch", f"""SELECT event_id,
  cast((cast(ts AS DATE) - {C.EPOCH}) * 24 + hour(ts) AS INTEGER) AS hours,
  date_trunc('hour', ts) AS back FROM events""")
def hours_since_epoch(spark, sf):
    hours = dates.hours_since_epoch(F.col("ts").cast("date"), F.hour("ts"))
    return A.table(spark, sf, "events").select(
        "event_id", hours.alias("hours"), dates.hours_to_timestamp(hours).alias("back"))


@query("month_length",
       "SELECT o_orderkey, cast(day(last_day(cast(o_orderdate AS DATE))) AS INTEGER) AS days FROM orders")
def month_length(spark, sf):
    days = dates.month_length(F.year("o_orderdate"), F.month("o_orderdate"))
    return A.table(spark, sf, "orders").select("o_orderkey", days.alias("days"))


@query("parse_hour",
       f"WITH {C.RAW_HOURLY} SELECT src_event, hour_text, {C.hour('hour_text')} AS hour FROM raw")
def parse_hour(spark, sf):
    return A.hourly_texts(spark, sf).select(
        "src_event", "hour_text", dates.parse_hour(F.col("hour_text")).alias("hour"))


@query("measure_value", f"WITH {C.RAW_DAILY} SELECT {_KEYS}, {C.number('tmp_v')} AS value FROM raw")
def measure_value(spark, sf):
    return A.daily_raw(spark, sf).select(
        *A.DAILY_KEYS, measures.measure_value(F.col("DayAirTmpAvg")).alias("value"))


@query("scale_values", f"WITH {C.RAW_DAILY} SELECT {_KEYS}, " + ", ".join(
    f"{C.fixed(C.number('eto_v'), factor)} AS scale_{kind}" for kind, factor in SCALES.items())
    + " FROM raw")
def scale_values(spark, sf):
    value = measures.parse_number(F.col("eto_v"))
    return A.daily_texts(spark, sf).select(
        *A.DAILY_KEYS, *(measures.scale(value, k).alias(f"scale_{k}") for k in SCALES))


@query("unscale_values", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"cast(l_partkey % 1000 AS DOUBLE) / {factor}::DOUBLE AS unscale_{kind}"
    for kind, factor in SCALES.items()) + " FROM lineitem")
def unscale_values(spark, sf):
    raw = F.col("l_partkey") % 1000
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *(measures.unscale(raw, k).alias(f"unscale_{k}") for k in SCALES))


@query("qc_bits", f"""WITH {C.RAW_DAILY}, n AS (SELECT *, cast(src_part % 256 AS INTEGER) AS bits FROM raw)
SELECT {_KEYS},
  cast((CASE WHEN {C.flagged('tmp_v', 'tmp_q')} THEN 1 ELSE 0 END)
    + (CASE WHEN {C.flagged('eto_v', 'eto_q')} THEN 2 ELSE 0 END) AS INTEGER) AS qc_flags,
  concat_ws(',', {', '.join(f"CASE WHEN bits & {b} <> 0 THEN '{n}' END" for n, b in QC_BITS.items())}) AS names
FROM n""")
def qc_bits(spark, sf):
    raw = A.daily_raw(spark, sf)
    bits = (F.col("src_part") % 256).cast("int")
    return raw.select(
        *A.DAILY_KEYS,
        measures.qc_bits(
            temperature=measures.qc_flagged(F.col("DayAirTmpAvg")),
            et=measures.qc_flagged(F.col("DayAsceEto"))).alias("qc_flags"),
        F.array_join(measures.qc_names(bits), ",").alias("names"))


# Station lists with ranges, padding, backward ranges and malformed parts.
STATION_LISTS = """
  c_custkey,
  CASE c_custkey % 8 WHEN 0 THEN '2'
    WHEN 1 THEN concat(cast(c_custkey % 50 AS string), ',', cast(c_custkey % 9 + 1 AS string), '-',
      cast(c_custkey % 9 + 4 AS string), ',', cast(c_custkey % 7 AS string))
    WHEN 2 THEN ' 2 , 5 , 10 ' WHEN 3 THEN 'abc' WHEN 4 THEN '1-2-3'
    WHEN 5 THEN concat(cast(c_custkey % 20 + 5 AS string), '-', cast(c_custkey % 20 AS string))
    WHEN 6 THEN 'abc-5'
    ELSE concat('+', cast(c_custkey % 30 AS string), ', 7 - 9,7') END AS stations
"""
_LISTS_SQL = rf"""WITH src AS (SELECT {STATION_LISTS} FROM customer),
parts AS (SELECT c_custkey, trim(unnest(string_split(stations, ','))) AS p FROM src),
ok AS (SELECT c_custkey, bool_and(regexp_full_match(p, '\+?\d+(\s*-\s*\+?\d+)?')) AS ok FROM parts GROUP BY 1),
ends AS (SELECT parts.c_custkey, cast(trim(split_part(p, '-', 1)) AS BIGINT) AS lo,
  cast(trim(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END) AS BIGINT) AS hi
  FROM parts JOIN ok ON parts.c_custkey = ok.c_custkey WHERE ok),
ids AS (SELECT c_custkey, unnest(generate_series(lo, hi)) AS station_id FROM ends)
"""


def _lists(spark, sf):
    return spark.sql(f"SELECT {STATION_LISTS} FROM {{c}}", c=A.table(spark, sf, "customer"))


@query("expand_station_list", f"""{_LISTS_SQL}
SELECT ok.c_custkey, ok, station_id FROM ok LEFT JOIN ids ON ok.c_custkey = ids.c_custkey""")
def expand_station_list(spark, sf):
    return ranges.expand_stations(_lists(spark, sf), "stations").select("c_custkey", "ok", "station_id")


@query("sorted_stations", f"""{_LISTS_SQL}
SELECT ok.c_custkey, CASE WHEN ok.ok THEN
  coalesce(string_agg(cast(station_id AS VARCHAR), ',' ORDER BY station_id), '') END AS ids
FROM ok LEFT JOIN ids ON ok.c_custkey = ids.c_custkey GROUP BY ok.c_custkey, ok.ok""")
def sorted_stations(spark, sf):
    """Malformed lists give null, lists of nothing an empty text."""
    ids = texts.sorted_ids(texts.station_list(F.col("stations")))
    return _lists(spark, sf).select(
        "c_custkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("requested_stations", """SELECT cast(c_custkey % 200 AS INTEGER) AS station_id, c_custkey AS ordinal
FROM customer ORDER BY 1, 2""")
def requested_stations(spark, sf):
    from gaugeworks.plans.scans import batch_requests

    return ranges.sorted_stations(batch_requests(spark, sf), "ordinal")


def _plain_sql(value):
    return f"regexp_replace(regexp_replace(cast({value} AS VARCHAR), '0+$', ''), '\\.$', '')"


_LAT = "cast(30 + c_custkey % 977 * 0.0137 AS decimal(9,4))"
_LNG = "cast(c_custkey % 61 * 0.25 - 125 AS decimal(9,4))"


# Numbers that are printed with an exponent unless told otherwise.
_ODD = """cast(CASE c_custkey % 4 WHEN 0 THEN -0.0005 WHEN 1 THEN 12345678.5 WHEN 2 THEN 0.0000007
  ELSE -120000000 END AS decimal(18,7))"""


@query("format_coordinates", f"""SELECT c_custkey,
  concat('lat=', {_plain_sql(_LAT)}, ',lng=', {_plain_sql(_LNG)},
    ';lat=', {_plain_sql(_ODD)}, ',lng=', {_plain_sql(_LAT)}) AS coordinates FROM customer""")
def format_coordinates(spark, sf):
    point = lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lng"))
    lat, lng = F.expr(_LAT), F.expr(_LNG)
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        texts.coordinates_text(F.array(point(lat, lng), point(F.expr(_ODD), lat))).alias("coordinates"))


@query("format_addresses", """SELECT c_custkey,
  concat('addr-name=', c_name, ',addr=', c_mktsegment, ' Street',
    ';addr-name=other,addr=', c_name) AS addresses FROM customer""")
def format_addresses(spark, sf):
    place = lambda a, b: F.struct(a.alias("name"), b.alias("address"))
    street = F.concat("c_mktsegment", F.lit(" Street"))
    both = F.array(place(F.col("c_name"), street), place(F.lit("other"), F.col("c_name")))
    return A.table(spark, sf, "customer").select(
        "c_custkey", texts.addresses_text(both).alias("addresses"))


@query("status_hint", f"""WITH {LOG}
SELECT ordinal, status_code, CASE
  WHEN status_code IN (401, 403) THEN 'credentials'
  WHEN status_code = 429 THEN 'slow_down'
  WHEN status_code >= 500 THEN 'later' END AS hint FROM log""")
def status_hint(spark, sf):
    return A.fetch_log(spark, sf).select(
        "ordinal", "status_code", texts.status_hint(F.col("status_code")).alias("hint"))


@query("retry_class", f"""WITH {LOG}
SELECT ordinal, status_code, error, CASE WHEN error IS NULL THEN NULL
  WHEN status_code >= 400 AND status_code < 500 AND status_code <> 429 THEN false
  WHEN status_code = 429 OR status_code >= 500 THEN true
  ELSE {' OR '.join(f"contains(error, '{t}')" for t in texts.RETRYABLE_TEXTS)} END AS should_retry
FROM log""")
def retry_class(spark, sf):
    return reports.retry_class(A.fetch_log(spark, sf))


@query("retry_schedule", f"""WITH {LOG}
SELECT ordinal, cast(a AS INTEGER) AS attempt,
  cast(CASE WHEN a = 0 THEN 0 ELSE 2 ** a END AS BIGINT) AS wait_s,
  CASE WHEN a = 0 THEN 0 ELSE 2 ** a END / 2.0::DOUBLE AS max_jitter_s
FROM log, generate_series(0, 3) AS g(a)""")
def retry_schedule(spark, sf):
    return reports.retry_schedule(A.fetch_log(spark, sf), 3)
