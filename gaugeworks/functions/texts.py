"""Station lists, target texts, status hints and retry rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ID = r"[+]?\d{1,18}"
_SINGLE = rf"^{_ID}\z"
_RANGE = rf"^{_ID}\s*-\s*{_ID}\z"

# Error texts that make a failure worth retrying.
RETRYABLE_TEXTS = (
    "timeout", "connection refused", "connection reset",
    "EOF", "broken pipe", "no such host",
)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def station_spans(text: Column) -> Column:
    """First and last ids (``low``, ``high``) that a list such as ``2,5-7,10`` names,
    a single id being both; null when any part is malformed.

    A range that runs backwards names nothing.
    """
    parts = F.transform(F.split(text, ",", -1), _trim)
    whole = F.forall(
        parts,
        lambda p: F.when(p.contains("-"), p.rlike(_RANGE)).otherwise(p.rlike(_SINGLE)),
    )

    def span(part):
        ends = F.split(part, "-")
        low = _trim(F.get(ends, F.lit(0))).try_cast("bigint")
        high = F.coalesce(_trim(F.get(ends, F.lit(1))).try_cast("bigint"), low)
        return F.struct(low.alias("low"), high.alias("high"))

    spans = F.transform(F.when(whole, parts), span)
    return F.filter(spans, lambda s: s["low"] <= s["high"])


def station_list(text: Column) -> Column:
    """All ids of a list as one array; ``ranges.expand_stations`` takes long ranges."""
    return F.flatten(F.transform(station_spans(text), lambda s: F.sequence(s["low"], s["high"])))


def sorted_ids(ids: Column) -> Column:
    """Ascending ids; repeated ids stay."""
    return F.array_sort(ids)


def _plain_number(value: Column) -> Column:
    """Decimals that read back to the same number, without an exponent.

    They are the digits of the engine's own text, in a decimal that holds them all; numbers
    of more than 38 digits before or 37 behind the point have no text.
    """
    number = value.cast("double")
    text, size = number.cast("string"), F.abs(number)
    held = lambda kind: text.try_cast(kind).cast("string")
    plain = (
        F.when(~text.contains("E"), text)
        .when(size < 1, held("decimal(38,37)")).when(size < 1e20, held("decimal(38,18)"))
        .otherwise(held("decimal(38,0)"))
    )
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")


def coordinates_text(points: Column) -> Column:
    """Array of ``(lat, lng)`` structs as ``lat=..,lng=..`` joined by ``;``."""
    one = lambda p: F.concat(
        F.lit("lat="), _plain_number(p["lat"]), F.lit(",lng="), _plain_number(p["lng"])
    )
    return F.array_join(F.transform(points, one), ";")


def addresses_text(places: Column) -> Column:
    """Array of ``(name, address)`` structs as one request text."""
    one = lambda p: F.concat(F.lit("addr-name="), p["name"], F.lit(",addr="), p["address"])
    return F.array_join(F.transform(places, one), ";")


def status_hint(status: Column) -> Column:
    """A short code of what to do about a response status; null when there is nothing to say."""
    return (
        F.when(status.isin(401, 403), "credentials")
        .when(status == 429, "slow_down")
        .when(status >= 500, "later")
    )


def should_retry(error: Column, status: Column) -> Column:
    """Null without an error, else whether another attempt may help."""
    by_text = F.lit(False)
    for text in RETRYABLE_TEXTS:
        by_text = by_text | error.contains(text)
    return (
        F.when(error.isNull(), F.lit(None).cast("boolean"))
        .when((status == 429) | (status >= 500), True)
        .when((status >= 400) & (status < 500), False)
        .otherwise(by_text)
    )


def backoff_seconds(attempt: Column) -> Column:
    """Wait before ``attempt``: none before the first, then doubling."""
    return F.when(attempt > 0, F.pow(F.lit(2), attempt)).otherwise(F.lit(0)).cast("bigint")
