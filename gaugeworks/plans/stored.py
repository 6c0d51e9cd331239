"""Stores of the given tables, written once per session and table folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import quality
from gaugeworks.plans import checks as C
from gaugeworks.plans.projections import daily_obs, hourly_obs
from gaugeworks.session import scratch
from gaugeworks.sources import fixedwidth, snapshots, store

INGEST = "full"
KEPT_DAILY = f"{C.daily()}, kept AS (SELECT * FROM obs WHERE {C.VALID_DAILY})"
KEPT_HOURLY = f"{C.hourly()}, kept AS (SELECT * FROM obs WHERE {C.VALID_HOURLY})"
CATALOG_SQL = """catalog AS (SELECT station_id, year, count(*) AS row_count, min(ts) AS min_ts,
  max(ts) AS max_ts FROM kept GROUP BY station_id, year)"""
# The catalog of a store that holds both kinds of rows.
BOTH_SQL = f"""WITH catalog AS (
  SELECT *, 'daily' AS data_type FROM ({KEPT_DAILY}, {CATALOG_SQL} SELECT * FROM catalog)
  UNION ALL SELECT *, 'hourly' FROM ({KEPT_HOURLY}, {CATALOG_SQL} SELECT * FROM catalog))"""

# Years of the first station group: one is deleted, one overwritten, one gets a file too many.
GONE, JUNK, EXTRA = 1997, 1996, 1998

# Ingests that the rows of one store came in, and its first year that is not closed.
INGESTS, OPEN = 200, 1998

_ROOTS: dict[tuple[str, str, str], str] = {}


def _write(spark, sf, name):
    root = scratch(spark, f"store-{name}")
    for kind, obs in (("daily", daily_obs(spark, sf)), ("hourly", hourly_obs(spark, sf))):
        store.write_obs(quality.valid(obs, kind), root, kind, INGEST)
        store.write_catalog(spark, root, kind, INGEST)
        snapshots.publish(spark, root, kind, INGEST)
    return root


def stored_root(spark, sf):
    """A store of all valid rows, daily and hourly ones."""
    key = (spark.sparkContext.applicationId, sf, "whole")
    if key not in _ROOTS:
        _ROOTS[key] = _write(spark, sf, "whole")
    return _ROOTS[key]


def _write_many(spark, sf):
    root = scratch(spark, "store-many")
    number = (F.col("station_id") * 31 + F.col("year")) % INGESTS
    store.write_all(quality.valid(daily_obs(spark, sf), "daily"), root, "daily",
                    F.concat(F.lit("run-"), number.cast("string")))
    snapshots.publish(spark, root, "daily", *(f"run-{i}" for i in range(INGESTS)))
    return root


def many_root(spark, sf):
    """A daily store whose station-years came in many ingests."""
    key = (spark.sparkContext.applicationId, sf, "many")
    if key not in _ROOTS:
        _ROOTS[key] = _write_many(spark, sf)
    return _ROOTS[key]


def compacted_root(spark, sf):
    """A store like :func:`many_root`, whose closed years were compacted."""
    key = (spark.sparkContext.applicationId, sf, "compacted")
    if key not in _ROOTS:
        root = _write_many(spark, sf)
        snapshots.compact(spark, root, "daily", OPEN)
        _ROOTS[key] = root
    return _ROOTS[key]


def packed_root(spark, sf, kind):
    """Record files of all converted rows that fit a record."""
    key = (spark.sparkContext.applicationId, sf, f"packed-{kind}")
    if key not in _ROOTS:
        root = scratch(spark, f"packed-{kind}")
        fixedwidth.write_packed(daily_obs(spark, sf) if kind == "daily" else hourly_obs(spark, sf), root, kind)
        _ROOTS[key] = root
    return _ROOTS[key]


def damaged_root(spark, sf):
    """A daily store that was damaged after it had been recorded."""
    key = (spark.sparkContext.applicationId, sf, "damaged")
    if key not in _ROOTS:
        root = _write(spark, sf, "damaged")
        group = lambda year: f"{root}/data_type=daily/ingest_id={INGEST}/year={year}/station_group=0"
        store.delete(spark, group(GONE))
        for path in store.listed(spark, f"{group(JUNK)}/*.parquet"):
            store.put_bytes(spark, path, b"no table")
        store.put_bytes(spark, f"{group(EXTRA)}/stray.parquet", b"no table")
        _ROOTS[key] = root
    return _ROOTS[key]
