"""Flattened records to stored observations and back to physical units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.functions import dates, measures
from gaugeworks.functions.measures import scale, to_int
from gaugeworks.schemas import DAILY_MEASURES, OBS_COLUMNS, TIME_COLUMN


def computed(records: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each computed once per row.

    A filter on a projected expression is pushed below the projection together
    with a copy of the expression, so every condition on a reading would parse
    its text again.  Filters do not pass a generator, here one of one element.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return records.select(*keep, F.inline(F.array(row)))


def drop_bad_dates(records: DataFrame, rule: Callable[[Column], Column] = dates.parse_iso_date) -> DataFrame:
    """Rows whose ``Date`` the rule accepts, with their epoch day."""
    day = dates.days_since_epoch(rule(F.col("Date")))
    return computed(records, "*", ts=day).where(F.col("ts") >= 0)


def drop_nonpositive_ts(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("ts") > 0)


def _text_number(measure: Column) -> Column:
    # Scaling turns an infinite number into 0, so no check is needed here.
    return measures.parse_number(measure["Value"])


def _daily(records, rule, number, keep=()):
    value = lambda name: number(F.col(name))
    rows = computed(
        records, *keep, "station_id",
        ts=dates.days_since_epoch(rule(F.col("Date"))),
        temperature=scale(value("DayAirTmpAvg"), "temp"),
        et=scale(value("DayAsceEto"), "et_daily"),
        wind_speed=scale(value("DayWindSpdAvg"), "wind"),
        humidity=to_int(value("DayRelHumAvg")),
        solar_radiation=to_int(value("DaySolRadAvg") * 10),
        qc_flags=measures.qc_bits(
            temperature=measures.qc_flagged(F.col("DayAirTmpAvg")),
            et=measures.qc_flagged(F.col("DayAsceEto")),
        ),
    )
    return _timed(rows, "daily", keep)


def _timed(rows: DataFrame, kind: str, keep) -> DataFrame:
    """Drop rows without a time or from before the epoch; add the time and its year."""
    time = dates.time_of(F.col("ts"), kind)
    derived = {"year": F.year(time), TIME_COLUMN[kind]: time}
    return rows.where(F.col("ts") >= 0).select(
        *keep, *(derived[c].alias(c) if c in derived else F.col(c) for c in OBS_COLUMNS[kind]))


def convert_daily(records: DataFrame, keep=()) -> DataFrame:
    """Daily records to fixed point; rows with a malformed date are dropped."""
    return _daily(records, dates.parse_iso_date, _text_number, keep)


def convert_daily_lenient(records: DataFrame, keep=()) -> DataFrame:
    return _daily(records, dates.lenient_date, _text_number, keep)


def minimal(records: DataFrame) -> DataFrame:
    """Measurements with numeric values and no unit."""
    for name in DAILY_MEASURES:
        m = F.col(name)
        records = records.withColumn(
            name,
            F.when(m.isNotNull(), F.struct(
                m["Value"].try_cast("double").alias("Value"), m["Qc"].alias("Qc"))),
        )
    return records


def _numeric(measure: Column) -> Column:
    return F.coalesce(measure["Value"], F.lit(0.0))


def convert_daily_minimal(records: DataFrame, keep=()) -> DataFrame:
    """Numeric daily records to fixed point; keeps the epoch day."""
    return _daily(records, dates.lenient_date, _numeric, keep)


def convert_daily_strict(records: DataFrame, keep=()) -> DataFrame:
    """As the minimal converter, but the epoch day counts as undated."""
    return drop_nonpositive_ts(convert_daily_minimal(records, keep))


def _hourly(records, rule, keep=()):
    value = lambda name: _text_number(F.col(name))
    rows = computed(
        records, *keep, "station_id",
        ts=dates.hours_since_epoch(rule(F.col("Date")), dates.parse_hour(F.col("Hour"))),
        temperature=scale(value("HlyAirTmp"), "temp"),
        et=scale(value("HlyAsceEto"), "et_hourly"),
        wind_speed=scale(value("HlyWindSpd"), "wind"),
        wind_direction=to_int(value("HlyWindDir") / 2),
        humidity=to_int(value("HlyRelHum")),
        solar_radiation=to_int(value("HlySolRad")),
        precipitation=scale(value("HlyPrecip"), "precip"),
        vapor_pressure=scale(value("HlyVapPres"), "vapor"),
        qc_flags=measures.qc_bits(temperature=measures.qc_flagged(F.col("HlyAirTmp"))),
    )
    return _timed(rows, "hourly", keep)


def convert_hourly(records: DataFrame, keep=()) -> DataFrame:
    return _hourly(records, dates.parse_iso_date, keep)


def convert_hourly_lenient(records: DataFrame, keep=()) -> DataFrame:
    return _hourly(records, dates.lenient_date, keep)


_UNITS = {
    "daily": {
        "temperature": "temp", "et": "et_daily", "wind_speed": "wind",
        "solar_radiation": "solar",
    },
    "hourly": {
        "temperature": "temp", "et": "et_hourly", "wind_speed": "wind",
        "wind_direction": "wind_dir", "precipitation": "precip", "vapor_pressure": "vapor",
    },
}


def decode(obs: DataFrame, kind: str) -> DataFrame:
    """Stored fixed-point columns in physical units, time rebuilt from ``ts``."""
    units = _UNITS[kind]
    columns = []
    for name in OBS_COLUMNS[kind]:
        if name == TIME_COLUMN[kind]:
            columns.append(dates.time_of(F.col("ts"), kind).alias(name))
        elif name in units:
            columns.append(measures.unscale(F.col(name), units[name]).alias(name))
        else:
            columns.append(F.col(name))
    return obs.select(*columns)
