"""Key lookups between plans, catalog, stored rows and dimensions.

No side is broadcast by hand: dimensions and catalogs grow with the data, so the
engine decides from their measured size and splits skewed shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.sources.store import CHUNK_KEY, station_group


def pending_chunks(plan: DataFrame, catalog: DataFrame) -> DataFrame:
    """Planned station-years that are not stored yet."""
    return plan.join(catalog.select(*CHUNK_KEY), list(CHUNK_KEY), "left_anti")


def catalog_semi(obs: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """Stored rows of one kind whose station-year the catalog lists.

    Year and station group are folders of the store, so that the engine reads only
    those that the listed entries name.
    """
    listed = catalog.where(F.col("data_type") == kind).select(
        "station_id", "year", station_group(F.col("station_id")).alias("station_group"))
    return obs.join(listed, ["station_group", "year", "station_id"], "left_semi")


def missing_chunks(catalog: DataFrame, obs: DataFrame, kind: str) -> DataFrame:
    """Catalog entries of one kind without any readable row."""
    readable = obs.select("station_id", "year").distinct()
    return catalog.where(F.col("data_type") == kind).join(readable, ["station_id", "year"], "left_anti")


def station_zip_join(stations: DataFrame, zips: DataFrame) -> DataFrame:
    """Stations with the zip rows that name both the station and one of its zips."""
    listed = stations.select(
        F.col("StationNbr").try_cast("int").alias("station_id"), "Name",
        F.explode("ZipCodes").alias("zip_code"),
    )
    mapped = zips.select(
        F.col("StationNbr").alias("station_id"), F.col("ZipCode").alias("zip_code"),
        F.col("IsActive").alias("zip_active"),
    )
    return listed.join(mapped, ["station_id", "zip_code"])


def batch_outcome(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every request with its outcome; a station nothing came back for stays empty."""
    return requests.join(outcomes, "station_id", "left").select(
        "ordinal", "station_id",
        F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), "error",
    )
