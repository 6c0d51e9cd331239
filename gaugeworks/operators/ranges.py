"""Range queries over stored observations and the chunk catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeworks.functions.dates import ts_of
from gaugeworks.functions.texts import station_spans
from gaugeworks.sources.store import station_group

PREVIEW_ROWS = 10
_RANGE_STEPS = (1 << 40, 1 << 20)


def _between(kind: str, start: str, end: str) -> Column:
    """From the start day up to but not including the end day."""
    ts = F.col("ts")
    return (ts >= ts_of(start, kind)) & (ts < ts_of(end, kind))


def query_range(obs: DataFrame, kind: str, station: int, start: str, end: str) -> DataFrame:
    """Rows of one station from ``start`` up to but not including ``end``.

    Year and station group prune folders, the station and time bounds prune row
    groups inside the files that are left.
    """
    rows = obs.where(
        (F.col("station_id") == station)
        & F.col("year").between(int(start[:4]), int(end[:4]))
    )
    if "station_group" in obs.columns:
        rows = rows.where(F.col("station_group") == station_group(F.lit(station)))
    return rows.where(_between(kind, start, end))


def preview(rows: DataFrame, *order: str, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in time order; the report shows no more than these."""
    return rows.orderBy(*order).limit(limit)


def query_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_records"))


def days_before(reference: str, days: int) -> str:
    return (dt.date.fromisoformat(reference) - dt.timedelta(days=days)).isoformat()


def recent_days(obs: DataFrame, kind: str, reference: str, days: int) -> DataFrame:
    """Rows of the ``days`` days before ``reference``."""
    start = days_before(reference, days)
    return obs.where(F.col("year").between(int(start[:4]), int(reference[:4])) & _between(kind, start, reference))


def chunk_select(catalog: DataFrame, station: int, first: int, last: int, kind: str) -> DataFrame:
    """Catalog rows of one station within a span of years; none means no data."""
    return catalog.where(
        (F.col("station_id") == station)
        & F.col("year").between(first, last)
        & (F.col("data_type") == kind)
    )


def expand_stations(requests: DataFrame, text: str) -> DataFrame:
    """A row per id that the list ``text`` names, as ``station_id``, and ``ok``, whether
    the list is well formed.  A list of nothing or a malformed one keeps one row.

    Ranges are cut in steps, so that no array grows with the length of a range.
    """
    rows = requests.withColumn("_spans", station_spans(F.col(text)))
    rows = rows.withColumn("ok", F.col("_spans").isNotNull()).withColumn("_span", F.explode_outer("_spans"))
    rows = rows.select(*requests.columns, "ok", F.col("_span.low").alias("_low"), F.col("_span.high").alias("_high"))
    for step in _RANGE_STEPS:
        starts = F.sequence("_low", "_high", F.lit(step).cast("bigint"))
        rows = rows.select(*requests.columns, "ok", F.explode_outer(starts).alias("_low"), "_high").withColumn(
            "_high", F.least(F.col("_high"), F.col("_low") + (step - 1)))
    return rows.select(
        *requests.columns, "ok", F.explode_outer(F.sequence("_low", "_high")).alias("station_id"))


def sorted_stations(requests: DataFrame, *more: str) -> DataFrame:
    """Requested stations in ascending order, repeats kept."""
    return requests.orderBy("station_id", *more)


def in_request_order(outcomes: DataFrame) -> DataFrame:
    return outcomes.orderBy("ordinal")


def placed(rows: DataFrame, key: str, spread: int = 1 << 16) -> DataFrame:
    """``rows`` with their place, from 0, in the order of the whole number ``key``.

    The key's values are cut into spans; rows are numbered within a span, and the
    counts of the spans before are added.  Only the counts are ordered as a whole.
    Rows that share a key have places next to each other, in any order; those
    without a key come first.
    """
    spans = rows.withColumn("_span", F.floor(F.col(key) / F.lit(spread)))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_span").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = spans.withColumn("_nth", F.row_number().over(Window.partitionBy("_span").orderBy(key)))
    return numbered.join(starts, F.col("_span").eqNullSafe(F.col("_of"))).select(
        *rows.columns, (F.col("_start") + F.col("_nth") - 1).alias("place"))
