"""Ordered computations along each station's readings.

A station's readings are cut into segments along the first column of the order,
at fixed values.  Each segment is computed by itself and receives one carried
row, or one carried total, from the segments before it.  The cut depends on the
data alone: a station with very many readings is spread over as many groups as
it has segments, and building a query starts no job.

Rows are shuffled once, by segment.  What is carried is derived from the same rows
in the same columns, so that the engine reuses that shuffle, and the carried rows
join on its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Units of the order's first column (days or hours) that a segment spans.
SPAN = 64


class Segments:
    """Rows of ``keys`` in ``order``, as consecutive segments."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], span: int = SPAN):
        # Nulls come first in the order.
        cut = F.coalesce(F.floor(F.col(order[0]) / F.lit(span)), F.lit(-(1 << 62)))
        # A struct equals another with nulls in the same places.
        self.df = df.withColumn("_segment", F.struct(F.struct(*keys).alias("of"), cut.alias("at"))) \
            .drop(*keys).repartition("_segment")
        self.keys, self.order = list(keys), list(order)
        self.window = Window.partitionBy("_segment").orderBy(*self.order)
        self.segments = Window.partitionBy("_segment.of").orderBy("_segment.at")

    def _carry(self, small: DataFrame) -> DataFrame:
        """Bring one row per segment to the segment's rows."""
        return self.df.join(small, "_segment")

    def previous(self, columns: list[str], out: str) -> None:
        """Add the row before each, over segment bounds, as a struct."""
        values = F.struct(*columns)
        carried = (
            self.df.groupBy("_segment")
            .agg(F.max_by(values, F.struct(*self.order)).alias("_last"))
            .select("_segment", F.lag("_last").over(self.segments).alias("_carried"))
        )
        self.df = self.df.withColumn("_inner", F.lag(values).over(self.window))
        self.df = (
            self._carry(carried)
            .withColumn(out, F.coalesce("_inner", "_carried")).drop("_inner", "_carried")
        )

    def running(self, sums: dict[str, str]) -> None:
        """Add running sums, as a map of column to its sum's name."""
        before = self.segments.rowsBetween(Window.unboundedPreceding, -1)
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.df = self.df.withColumns({
            "_nth": F.row_number().over(self.window), **{f"_inner_{c}": F.sum(c).over(upto) for c in sums}})
        # A segment's totals are the sums at its last row.
        totals = self.df.groupBy("_segment").agg(*(F.max_by(f"_inner_{c}", "_nth").alias(f"_total_{c}") for c in sums))
        offsets = totals.select("_segment", *(
            F.coalesce(F.sum(f"_total_{c}").over(before), F.lit(0)).alias(f"_offset_{c}") for c in sums))
        self.df = self._carry(offsets).withColumns(
            {out: F.col(f"_inner_{c}") + F.col(f"_offset_{c}") for c, out in sums.items()}
        ).drop("_nth", *(f"{part}_{c}" for c in sums for part in ("_inner", "_offset")))

    def done(self) -> DataFrame:
        return self.df.withColumns({k: F.col(f"_segment.of.{k}") for k in self.keys}).drop("_segment")


def _ordered(columns: list[str], order: list[str]) -> tuple[list[str], list[str]]:
    """The order by names that do not change, and which of its columns do."""
    clash = [c for c in order if c in columns]
    return [f"_by_{c}" if c in clash else c for c in order], clash


def delta_columns(
    obs: DataFrame, columns: list[str], order: list[str], keys=("station_id",), span: int = SPAN,
) -> DataFrame:
    """Replace each column by its change from the reading before; the first keeps its value."""
    by, clash = _ordered(columns, order)
    kept = obs.withColumns({f"_by_{c}": F.col(c) for c in clash}) if clash else obs
    rows = Segments(kept, list(keys), by, span)
    rows.previous(columns, "_before")
    return rows.done().withColumns({
        f"d_{c}": F.col(c) - F.coalesce(F.col(f"_before.{c}"), F.lit(0)) for c in columns
    }).drop("_before", *columns)


def undo_delta(
    deltas: DataFrame, columns: list[str], order: list[str], keys=("station_id",), span: int = SPAN,
) -> DataFrame:
    """Rebuild the values that ``delta_columns`` replaced."""
    by, clash = _ordered(columns, order)
    rows = Segments(deltas, list(keys), by, span)
    rows.running({f"d_{c}": c for c in columns})
    return rows.done().drop(*(f"d_{c}" for c in columns), *(f"_by_{c}" for c in clash))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, span: int = SPAN) -> DataFrame:
    """Number the rows of each key in order, from 1."""
    rows = Segments(df.withColumn("_one", F.lit(1)), keys, order, span)
    rows.running({"_one": out})
    return rows.done().drop("_one")


def value_runs(
    obs: DataFrame, column: str, order: list[str], keys=("station_id",), span: int = SPAN,
) -> DataFrame:
    """Runs of equal values along the order as ``(run_no, value, run_length)``."""
    narrow = obs.select(*dict.fromkeys([*keys, *order, column]))
    rows = Segments(narrow, list(keys), order, span)
    rows.previous([column], "_before")
    same = F.col("_before").isNotNull() & (F.col(f"_before.{column}") == F.col(column))
    rows.df = rows.df.withColumn("_start", F.when(same, 0).otherwise(1)).drop("_before")
    rows.running({"_start": "run_no"})
    return (
        rows.done().groupBy(*keys, "run_no")
        .agg(F.max(column).alias("value"), F.count("*").alias("run_length"))
    )
