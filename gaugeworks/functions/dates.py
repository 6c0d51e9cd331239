"""Dates, hours and counts since the 1985 epoch as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from gaugeworks.schemas import EPOCH_DATE, EPOCH_YEAR

# Years the lenient date rule accepts.
LENIENT_YEARS = (EPOCH_YEAR, 2100)
_LENIENT = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\z"


def _epoch() -> Column:
    return F.lit(EPOCH_DATE).cast("date")


def parse_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` to a date; anything else, or an impossible day, to null.

    The cast reads shorter forms and trailing text too, so the shape is fixed first.
    """
    shaped = (
        (F.length(text) == 10)
        & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
        & F.substring(text, 10, 1).between("0", "9")
    )
    return F.when(shaped, text).try_cast("date")


def parse_us_date(text: Column) -> Column:
    """``MM/DD/YYYY`` to a date, else null."""
    iso = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2))
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}\z"), iso).try_cast("date")


def parse_date(text: Column) -> Column:
    return F.coalesce(parse_iso_date(text), parse_us_date(text))


def format_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def normalize_date(text: Column) -> Column:
    """Either accepted format as ``YYYY-MM-DD``; other text is left alone."""
    return F.coalesce(format_date(parse_date(text)), text)


def lenient_parts(text: Column) -> Column:
    """Struct ``(y, m, d)`` under the lenient rule, null where it does not apply.

    Only bounds are checked, so any day 1-31 passes in any month.
    """
    part = lambda at, size: F.substring(text, at, size).try_cast("int")
    return F.when(
        _is_lenient(text),
        F.struct(part(1, 4).alias("y"), part(6, 2).alias("m"), part(9, 2).alias("d")),
    )


def _is_lenient(text: Column) -> Column:
    first, last = (str(y) for y in LENIENT_YEARS)
    return text.rlike(_LENIENT) & F.substring(text, 1, 4).between(first, last)


def lenient_date(text: Column) -> Column:
    """The lenient rule as a date: surplus days roll into the next month.

    Texts outside the rule go through the strict parser.
    """
    month = F.concat(F.substring(text, 1, 8), F.lit("01")).try_cast("date")
    surplus = F.substring(text, 9, 2).try_cast("int") - 1
    return F.when(_is_lenient(text), F.date_add(month, surplus)).otherwise(parse_iso_date(text))


def days_since_epoch(date: Column) -> Column:
    return F.datediff(date, _epoch())


def days_to_date(days: Column) -> Column:
    return F.date_add(_epoch(), days)


def hours_since_epoch(date: Column, hour: Column) -> Column:
    return days_since_epoch(date) * 24 + hour


def hours_to_timestamp(hours: Column) -> Column:
    """Hours since the epoch as a time without zone."""
    start = F.to_timestamp_ntz(F.lit(f"{EPOCH_DATE} 00:00:00"))
    return start + F.make_dt_interval(F.lit(0), hours)


def time_of(ts: Column, kind: str) -> Column:
    """Date of a daily, time of an hourly epoch count."""
    return days_to_date(ts) if kind == "daily" else hours_to_timestamp(ts)


def ts_of(day: str, kind: str) -> int:
    """Epoch count at which the day ``YYYY-MM-DD`` begins."""
    days = (dt.date.fromisoformat(day) - dt.date.fromisoformat(EPOCH_DATE)).days
    return days if kind == "daily" else days * 24


def month_length(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def parse_hour(text: Column) -> Column:
    """Hour from the first two characters; 0 when they are not a number."""
    head = F.substring(text, 1, 2)
    return F.coalesce(F.when(head.rlike(r"^(\d{2}|[+-]\d)\z"), head).try_cast("int"), F.lit(0))
