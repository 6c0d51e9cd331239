"""Scan queries: landed responses, dimensions and the request plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import lookups
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.registry import query
from gaugeworks.schemas import record_schema
from gaugeworks.sources import dimensions, requests, responses as R
from gaugeworks.streaming.ingest import scan_outcomes

_ZIPS = ["00003", "00011", "00042"]
_IN_ZIPS = "zip IN ('00003', '00011', '00042')"


def _values(records, *names):
    """Value text of the given measurements."""
    return [F.col(n)["Value"].alias(a) for n, a in names]


_DAILY_VALUES = (
    ("DayAirTmpAvg", "tmp_v"), ("DayAsceEto", "eto_v"), ("DayWindSpdAvg", "wnd_v"),
    ("DayRelHumAvg", "hum_v"), ("DaySolRadAvg", "sol_v"),
)
_HOURLY_VALUES = (
    ("HlyAirTmp", "tmp_v"), ("HlyAsceEto", "eto_v"), ("HlyWindSpd", "wnd_v"),
    ("HlyWindDir", "dir_v"), ("HlyRelHum", "hum_v"), ("HlySolRad", "sol_v"),
    ("HlyPrecip", "pre_v"), ("HlyVapPres", "vap_v"),
)


def _daily(records, measures=_DAILY_VALUES):
    return records.select(
        "station_id", F.col("Date").alias("day_text"), F.col("ZipCodes").alias("zip"),
        *_values(records, *measures))


def _hourly(records):
    return records.select(
        "station_id", F.col("Date").alias("day_text"), F.col("Hour").alias("hour_text"),
        F.col("provider_type").alias("kind"), *_values(records, *_HOURLY_VALUES))


_DAILY_SQL = f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, zip, tmp_v, eto_v, wnd_v, hum_v, sol_v FROM raw WHERE fault IS NULL"""
_HOURLY_SQL = f"""WITH {C.RAW_HOURLY}
SELECT station_id, day_text, hour_text, kind, tmp_v, eto_v, wnd_v, dir_v, hum_v, sol_v, pre_v, vap_v
FROM raw WHERE fault IS NULL"""


@query("scan_daily", _DAILY_SQL)
def scan_daily(spark, sf):
    return _daily(R.scan_daily(A.daily_landed(spark, sf)))


@query("scan_hourly", _HOURLY_SQL)
def scan_hourly(spark, sf):
    return _hourly(R.scan_hourly(A.hourly_landed(spark, sf)))


@query("scan_daily_by_zip", f"{_DAILY_SQL} AND {_IN_ZIPS}")
def scan_daily_by_zip(spark, sf):
    return _daily(R.scan_daily_by_zip(A.daily_bodies(spark, sf), _ZIPS))


@query("scan_hourly_by_zip", f"{_HOURLY_SQL} AND {_IN_ZIPS}")
def scan_hourly_by_zip(spark, sf):
    return _hourly(R.scan_hourly_by_zip(A.hourly_landed(spark, sf), _ZIPS))


_ZIP_VALUES = (("DayAsceEto", "eto_v"), ("DaySolRadAvg", "sol_v"), ("DayWindSpdAvg", "wnd_v"))
_POINT_VALUES = _ZIP_VALUES[:2]


@query("scan_spatial_zip", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, zip, eto_v, sol_v, wnd_v FROM raw
WHERE fault IS NULL AND kind = 'spatial' AND {_IN_ZIPS}""")
def scan_spatial_zip(spark, sf):
    return _daily(R.scan_spatial_zip(A.daily_bodies(spark, sf), _ZIPS), _ZIP_VALUES)


@query("scan_geo_zip", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, zip, eto_v, sol_v, wnd_v FROM raw
WHERE fault IS NULL AND {_IN_ZIPS}""")
def scan_geo_zip(spark, sf):
    return _daily(R.scan_geo_zip(A.daily_landed(spark, sf), _ZIPS), _ZIP_VALUES)


_COORDS = """SELECT DISTINCT concat('lat=', cast(30 + n_nationkey % 4 AS string), '.25,lng=-',
  cast(110 + n_nationkey % 3 AS string), '.5') AS coord FROM nation"""
_ADDRS = "SELECT concat(cast(100 + n_nationkey AS string), ' Main Street') AS addr FROM nation"


@query("scan_by_coordinate", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, zip, eto_v, sol_v FROM raw
WHERE fault IS NULL AND coord IN ({_COORDS})""")
def scan_by_coordinate(spark, sf):
    targets = A.table(spark, sf, "nation").selectExpr(
        "concat('lat=', cast(30 + n_nationkey % 4 AS string), '.25,lng=-', "
        "cast(110 + n_nationkey % 3 AS string), '.5') AS Coordinate")
    return _daily(R.scan_by_coordinate(A.daily_bodies(spark, sf), targets), _POINT_VALUES)


@query("scan_by_address", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, zip, eto_v, sol_v FROM raw
WHERE fault IS NULL AND addr IN ({_ADDRS})""")
def scan_by_address(spark, sf):
    targets = A.table(spark, sf, "nation").selectExpr(
        "concat(cast(100 + n_nationkey AS string), ' Main Street') AS Address")
    return _daily(R.scan_by_address(A.daily_bodies(spark, sf), targets), _POINT_VALUES)


@query("scan_daily_strict", f"""WITH {C.RAW_DAILY}
SELECT station_id, day_text, tmp_v, eto_v, wnd_v, hum_v, sol_v FROM raw
WHERE reject IS NULL""")
def scan_daily_strict(spark, sf):
    records = R.scan_daily_strict(A.daily_bodies(spark, sf))
    return records.select(
        "station_id", F.col("Date").alias("day_text"), *_values(records, *_DAILY_VALUES))


@query("strict_rejects", f"""WITH {C.RAW_DAILY}
SELECT station_id, reject, count(DISTINCT page) AS responses FROM raw
WHERE reject IS NOT NULL GROUP BY ALL""")
def strict_rejects(spark, sf):
    return R.strict_rejects(A.daily_landed(spark, sf)).groupBy("station_id", "reject").agg(
        F.count("*").alias("responses"))


@query("scan_rejects", f"""WITH {C.RAW_DAILY}
SELECT station_id, reject, count(DISTINCT page) AS responses FROM raw
WHERE fault IS NOT NULL GROUP BY ALL""")
def scan_rejects(spark, sf):
    return R.scan_rejects(A.daily_bodies(spark, sf)).groupBy("station_id", "reject").agg(
        F.count("*").alias("responses"))


# Requested stations repeat, and some of them have nothing landed.
REQUESTS_SQL = "requests AS (SELECT c_custkey AS ordinal, cast(c_custkey % 200 AS INTEGER) AS station_id FROM customer)"


def batch_requests(spark, sf):
    return A.table(spark, sf, "customer").selectExpr(
        "c_custkey AS ordinal", "cast(c_custkey % 200 AS int) AS station_id")


def station_outcomes(spark, sf):
    """Records and first error per station from one parse of the landed bodies."""
    return scan_outcomes(R.strict_records(A.daily_bodies(spark, sf)), "station_id")


def outcome_sql():
    inner = C.daily(C.lenient_date, extra="reject,")
    return inner + f""", counted AS (SELECT station_id, count(*) AS n FROM obs
  WHERE ts > 0 AND reject IS NULL GROUP BY 1),
asked AS (SELECT station_id, min(reject) AS error FROM raw GROUP BY 1),
outcomes AS (SELECT asked.station_id, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS records,
  error FROM asked LEFT JOIN counted ON asked.station_id = counted.station_id),
{REQUESTS_SQL}
SELECT ordinal, requests.station_id, cast(coalesce(records, 0) AS BIGINT) AS records, error
FROM requests LEFT JOIN outcomes ON requests.station_id = outcomes.station_id"""


@query("scan_batch", outcome_sql())
def scan_batch(spark, sf):
    return lookups.batch_outcome(batch_requests(spark, sf), station_outcomes(spark, sf))


_STATIONS_RAW = f"raw AS (SELECT {A.STATIONS} FROM supplier)"


@query("stations", f"""WITH {_STATIONS_RAW}
SELECT cast(station_id AS VARCHAR) AS "StationNbr", name AS "Name", active AS "IsActive",
  concat(zip_a, ',', zip_b) AS zips FROM raw""")
def stations(spark, sf):
    return dimensions.scan_stations(A.stations_landed(spark, sf)).select(
        "StationNbr", "Name", "IsActive", F.array_join("ZipCodes", ",").alias("zips"))


@query("station_by_number", f"""WITH {_STATIONS_RAW}
SELECT cast(station_id AS VARCHAR) AS "StationNbr", name AS "Name" FROM raw WHERE station_id = 2""")
def station_by_number(spark, sf):
    return dimensions.scan_station(A.stations_landed(spark, sf), 2).select("StationNbr", "Name")


@query("station_zips", f"""WITH {_STATIONS_RAW}
SELECT station_id AS "StationNbr", zip_b AS "ZipCode", active AS "IsActive" FROM raw""")
def station_zips(spark, sf):
    return dimensions.scan_zips(A.station_zips_landed(spark, sf)).select(
        "StationNbr", "ZipCode", "IsActive")


@query("spatial_zips", f"""WITH {_STATIONS_RAW}
SELECT cast(NULL AS INTEGER) AS "StationNbr", zip_b AS "ZipCode", active AS "IsActive" FROM raw""")
def spatial_zips(spark, sf):
    return dimensions.scan_zips(A.spatial_zips_landed(spark, sf)).select(
        "StationNbr", "ZipCode", "IsActive")


@query("zip_info", f"""WITH {_STATIONS_RAW}
SELECT station_id AS "StationNbr", zip_b AS "ZipCode" FROM raw WHERE zip_b = '00003'""")
def zip_info(spark, sf):
    return dimensions.zip_info(A.station_zips_landed(spark, sf), "00003").select(
        "StationNbr", "ZipCode")


# Requests of every endpoint; the texts hold characters that need escaping.
TARGETS = """
  c_custkey AS ordinal,
  CASE c_custkey % 13 WHEN 7 THEN 'stations' WHEN 8 THEN 'station' WHEN 9 THEN 'station_zips'
    WHEN 10 THEN 'station_zip' WHEN 11 THEN 'spatial_zips' WHEN 12 THEN 'spatial_zip'
    ELSE CASE c_custkey % 6 WHEN 0 THEN 'station_data' WHEN 1 THEN 'station_zip_data'
    WHEN 2 THEN 'spatial_coordinate_data' WHEN 3 THEN 'spatial_address_data'
    WHEN 4 THEN 'spatial_zip_data' ELSE 'geo_zip_data' END END AS endpoint,
  CASE c_custkey % 6 WHEN 0 THEN cast(c_custkey AS string)
    WHEN 2 THEN concat('lat=34.', cast(c_custkey % 100 AS string), ',lng=-118.5;lat=35,lng=-119')
    WHEN 3 THEN concat('addr-name=', c_name, ',addr=*', c_mktsegment, ' St ~', cast(c_custkey AS string))
    ELSE concat('93624,', lpad(cast(c_custkey % 97 AS string), 5, '0')) END AS target,
  CASE c_custkey % 3 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '02/29/2024' ELSE 'soon' END AS start_date,
  '12/31/2024' AS end_date,
  c_custkey % 4 = 1 AS hourly,
  CASE WHEN c_custkey % 12 = 5 THEN 'SCS' ELSE '' END AS prefer
"""
_BASE = "https://example.test/base"
_DATA_SQL = "endpoint LIKE '%\\_data' ESCAPE '\\'"
_ITEMS_SQL = f"""CASE WHEN endpoint IN ('spatial_zip_data', 'geo_zip_data') THEN '{requests.SPATIAL_ZIP_ITEMS}'
  WHEN endpoint IN ('spatial_coordinate_data', 'spatial_address_data') THEN '{requests.SPATIAL_POINT_ITEMS}'
  WHEN NOT {_DATA_SQL} THEN NULL
  WHEN hourly THEN '{requests.HOURLY_ITEMS}' ELSE '{requests.DAILY_ITEMS}' END"""
_PATH_SQL = "CASE endpoint " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in requests.PATHS.items()) + " END"


def _targets(spark, sf):
    return spark.sql(f"SELECT {TARGETS} FROM {{c}}", c=A.table(spark, sf, "customer"))


def _pair(key, text):
    return f"'{key}=' || replace(url_encode({text}), '%20', '+')"


def _normalized(text):
    return f"coalesce(strftime(coalesce({C.iso_date(text)}, {C.us_date(text)}), '%Y-%m-%d'), {text})"


_POINT_SQL = "endpoint IN ('spatial_coordinate_data', 'spatial_address_data')"


@query("request_plan", f"""WITH raw AS (SELECT {TARGETS} FROM customer),
planned AS (SELECT *, {_PATH_SQL} AS path, {_ITEMS_SQL} AS items FROM raw),
asked AS (SELECT *, concat_ws('&',
  CASE WHEN endpoint = 'spatial_address_data' THEN {_pair('addresses', 'target')} END,
  CASE WHEN endpoint = 'spatial_coordinate_data' THEN {_pair('coordinates', 'target')} END,
  {_pair('dataItems', 'items')},
  CASE WHEN {_DATA_SQL} THEN {_pair('endDate', _normalized('end_date'))} END,
  CASE WHEN {_DATA_SQL} AND NOT {_POINT_SQL} THEN 'isHourly=' || CASE WHEN hourly THEN 'true' ELSE 'false' END END,
  CASE WHEN endpoint = 'geo_zip_data' AND prefer <> '' THEN {_pair('prefer', 'prefer')} END,
  CASE WHEN {_DATA_SQL} THEN {_pair('startDate', _normalized('start_date'))} END,
  CASE WHEN endpoint = 'station' THEN {_pair('stationNbr', 'target')} END,
  CASE WHEN endpoint = 'station_data' THEN {_pair('stationNbrs', 'target')} END,
  CASE WHEN {_DATA_SQL} THEN 'unitOfMeasure=M' END,
  CASE WHEN endpoint IN ('station_zip', 'spatial_zip') THEN {_pair('zipCode', 'target')} END,
  CASE WHEN endpoint IN ('station_zip_data', 'spatial_zip_data', 'geo_zip_data')
    THEN {_pair('zipCodes', 'target')} END) AS query FROM planned)
SELECT ordinal, endpoint, path, items, query, concat('{_BASE}', path,
  CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url FROM asked""")
def request_plan(spark, sf):
    return requests.data_plan(_targets(spark, sf), _BASE).select(
        "ordinal", "endpoint", "path", "items", "query", "url")


@query("measure_list", f"""WITH raw AS (SELECT {TARGETS} FROM customer)
SELECT ordinal, {_ITEMS_SQL} AS items FROM raw""")
def measure_list(spark, sf):
    return _targets(spark, sf).select(
        "ordinal", requests.measure_list(F.col("endpoint"), F.col("hourly")).alias("items"))


@query("json_flatten", f"""WITH {C.RAW_DAILY}
, pages AS (SELECT cast(count(*) FILTER (kind = 'station') AS INTEGER) AS a,
  cast(count(*) FILTER (kind = 'spatial') AS INTEGER) AS b FROM raw WHERE fault IS NULL GROUP BY page)
SELECT 'first' AS provider, a AS records, count(*) AS responses FROM pages GROUP BY ALL
UNION ALL SELECT 'second', b, count(*) FROM pages GROUP BY ALL""")
def json_flatten(spark, sf):
    parsed = R.parse(A.daily_bodies(spark, sf), record_schema(("Date",), ()))
    providers = parsed.select(F.explode("_response.Data.Providers").alias("p"))
    return providers.groupBy(
        F.col("p.Name").alias("provider"), F.size("p.Records").alias("records"),
    ).agg(F.count("*").alias("responses"))


@query("flatten_providers", f"""WITH {C.RAW_DAILY}
SELECT station_id, CASE kind WHEN 'station' THEN 'first' ELSE 'second' END AS provider_name, kind AS provider_type, day_text AS "Date"
FROM raw WHERE fault IS NULL""")
def flatten_providers(spark, sf):
    return R.scan_daily(A.daily_landed(spark, sf), identity=("Date",), measures=()).select(
        "station_id", "provider_name", "provider_type", "Date")
