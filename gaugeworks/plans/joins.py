"""Key lookups between plan, catalog, stored rows and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import lookups
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.registry import query
from gaugeworks.plans.scans import batch_requests, outcome_sql, station_outcomes
from gaugeworks.plans.stored import CATALOG_SQL, GONE, JUNK, KEPT_DAILY, damaged_root, stored_root
from gaugeworks.schemas import DAILY_COLUMNS
from gaugeworks.sources import dimensions, requests, snapshots, store


def catalog(spark, sf):
    """Chunk catalog of the published ingests, daily and hourly."""
    return snapshots.read_catalog(spark, stored_root(spark, sf))


_LARGE = "row_count > 85"
_STORED_SQL = f"{KEPT_DAILY}, {CATALOG_SQL}"


@query("pending_chunks", f"""{_STORED_SQL},
plan AS (SELECT cast(s_suppkey AS INTEGER) AS station_id, cast(y AS INTEGER) AS year
  FROM supplier, generate_series(1995, 2001) AS g(y))
SELECT station_id, year, 'daily' AS data_type FROM plan
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.station_id = plan.station_id
  AND c.year = plan.year AND {_LARGE})""")
def pending_chunks(spark, sf):
    stations = A.station_texts(spark, sf)
    plan = requests.yearly(stations, 1995, 2001).withColumn("data_type", F.lit("daily"))
    return lookups.pending_chunks(plan, catalog(spark, sf).where(_LARGE)).select(
        "station_id", "year", "data_type")


@query("catalog_semi", f"""{_STORED_SQL}
SELECT {C.DAILY_COLUMNS} FROM kept
WHERE (station_id, year) IN (SELECT (station_id, year) FROM catalog WHERE {_LARGE})""")
def catalog_semi(spark, sf):
    stored = snapshots.read_obs(spark, stored_root(spark, sf), "daily")
    return lookups.catalog_semi(stored, catalog(spark, sf).where(_LARGE), "daily").select(*DAILY_COLUMNS)


@query("missing_chunks", f"""{_STORED_SQL}
SELECT station_id, year, 'daily' AS data_type, row_count FROM catalog
WHERE year IN ({GONE}, {JUNK}) AND station_id < {store.STATIONS_PER_GROUP}""")
def missing_chunks(spark, sf):
    root = damaged_root(spark, sf)
    readable = store.read_obs(spark, root, "daily", tolerant=True)
    return lookups.missing_chunks(snapshots.read_catalog(spark, root), readable, "daily").select(
        "station_id", "year", "data_type", "row_count")


@query("station_zip_join", f"""WITH raw AS (SELECT {A.STATIONS} FROM supplier),
listed AS (SELECT station_id, name, zip_a AS zip_code FROM raw
  UNION ALL SELECT station_id, name, zip_b FROM raw)
SELECT listed.station_id, listed.name AS "Name", zip_code, active AS zip_active
FROM listed JOIN raw ON listed.station_id = raw.station_id AND listed.zip_code = raw.zip_b""")
def station_zip_join(spark, sf):
    return lookups.station_zip_join(
        dimensions.scan_stations(A.stations_landed(spark, sf)),
        dimensions.scan_zips(A.station_zips_landed(spark, sf)))


@query("batch_outcome", outcome_sql() + " ORDER BY ordinal")
def batch_outcome(spark, sf):
    return lookups.batch_outcome(
        batch_requests(spark, sf), station_outcomes(spark, sf)).orderBy("ordinal")
