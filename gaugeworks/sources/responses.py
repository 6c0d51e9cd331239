"""Scans over landed response bodies.

A landed row is one response, or one page of it: the request it answers, its
landing order, the requested station, an error text for a failed request, and
the body.  Every scan is row-local up to the flattened records, so one station
with most of the responses needs no shuffle.

A scan parses the texts itself, only the fields that it names.  Bodies that many scans
share may be parsed once, by :func:`parsed`, and kept as variants: the scan of the file
itself then extracts those fields, without a JSON parser.  Parsing and storing such
variants costs as much as several scans of the texts.  All scans take landed rows of
either form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.functions import measures
from gaugeworks.schemas import (
    CORRUPT, DAILY_IDENTITY, DAILY_MEASURES, HOURLY_IDENTITY, HOURLY_MEASURES, LANDED,
    STRICT_RECORD, data_schema, record_schema, response_schema,
)

SPATIAL_ZIP_MEASURES = ("DayAsceEto", "DaySolRadAvg", "DayWindSpdAvg")
SPATIAL_POINT_MEASURES = ("DayAsceEto", "DaySolRadAvg")

# Fields that must be text, and what tells that they hold another kind of value.  Quotes
# inside a text are escaped, so that only a real key matches.
_TEXT_FIELDS = ("Date", "Value", "Qc")
_UNQUOTED = r'"{}"\s*:\s*[-0-9tf{{\[]'


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON line each, so that large files split."""
    return spark.read.schema(LANDED).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses kept as one file each below ``station_id=<n>`` folders."""
    name = F.col("_metadata.file_path")
    return (
        spark.read.text(path, wholetext=True)
        .withColumn("_name", name)
        .select(
            F.col("_name").alias("request_id"),
            F.lit(0).cast("bigint").alias("landed_seq"),
            F.col("station_id").cast("int").alias("station_id"),
            F.lit(None).cast("string").alias("error"),
            F.col("value").alias("body"),
        )
    )


def _is_unquoted(body: Column) -> Column:
    """Whether a body holds a value without quotes where text belongs.

    A pattern that begins with a fixed text is looked for by skips; one for all fields
    together would be tried at every character, which takes three times as long.
    """
    found = F.lit(False)
    for name in _TEXT_FIELDS:
        found = found | body.rlike(_UNQUOTED.format(name))
    return found


def parsed(landed: DataFrame) -> DataFrame:
    """Landed rows with the body as ``variant``, and what every scan asks of a body as a
    whole: whether there is a text, whether it is malformed, whether there are data at
    all, and whether it holds a value without quotes where text belongs, or one that is
    no strict number."""
    rows = landed.withColumn("variant", F.explode(F.array(F.try_parse_json("body"))))
    is_object = F.try_variant_get("variant", "$", "map<string, variant>")
    data = F.try_variant_get("variant", "$.Data", "variant")
    strict = F.try_variant_get("variant", "$.Data", data_schema(STRICT_RECORD))
    return rows.select(
        *(c for c in landed.columns if c != "body"), "variant",
        F.col("body").isNull().alias("no_body"),
        (is_object.isNull() & F.coalesce(F.trim("body") != "", F.lit(False))).alias("malformed"),
        (data.isNotNull() & ~F.coalesce(F.is_variant_null(data), F.lit(True))).alias("has_data"),
        F.coalesce(_is_unquoted(F.col("body")), F.lit(False)).alias("unquoted"),
        F.coalesce(_has_bad_value(strict["Providers"]), F.lit(False)).alias("bad_value"),
    )


def _is_parsed(landed: DataFrame) -> bool:
    return "variant" in landed.columns


def parse(landed: DataFrame, record: str) -> DataFrame:
    """Add the parsed body as ``_response``, whose ``_corrupt`` tells a malformed one.

    The one-element generator makes later steps share a single parse; the
    optimizer would otherwise copy the parser into each filter and column.  Fields of
    a variant are extracted by the scan, once.
    """
    if _is_parsed(landed):
        data = F.try_variant_get("variant", "$.Data", data_schema(record))
        corrupt = F.when(F.col("malformed") | (F.col("has_data") & data.isNull()), F.lit("malformed"))
        return landed.withColumn("_response", F.struct(data.alias("Data"), corrupt.alias(CORRUPT)))
    options = {"columnNameOfCorruptRecord": CORRUPT}
    response = F.from_json("body", response_schema(record), options)
    return landed.withColumn("_response", F.explode(F.array(response)))


def flatten_providers(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per record of every provider; records of one response stay together."""
    return (
        parsed.select(*keep, F.explode_outer("_response.Data.Providers").alias("_p"))
        .select(*keep, F.col("_p.Name").alias("provider_name"),
                F.col("_p.Type").alias("provider_type"),
                F.explode_outer("_p.Records").alias("_r"))
        .where(F.col("_r").isNotNull())
        .select(*keep, "provider_name", "provider_type", "_r.*")
    )


def scan_daily(
    landed: DataFrame, *keep: str, identity=DAILY_IDENTITY, measures=DAILY_MEASURES,
) -> DataFrame:
    """Daily records of all landed responses, with the named fields only."""
    return flatten_providers(parse(landed, record_schema(identity, measures)), "station_id", *keep)


def scan_hourly(
    landed: DataFrame, *keep: str, identity=HOURLY_IDENTITY, measures=HOURLY_MEASURES,
) -> DataFrame:
    return flatten_providers(parse(landed, record_schema(identity, measures)), "station_id", *keep)


def in_zips(zips: list[str]) -> Column:
    wanted = F.array(*(F.lit(z) for z in zips))
    return F.arrays_overlap(F.split("ZipCodes", ","), wanted)


def scan_daily_by_zip(landed: DataFrame, zips: list[str]) -> DataFrame:
    return scan_daily(landed).where(in_zips(zips))


def scan_hourly_by_zip(landed: DataFrame, zips: list[str]) -> DataFrame:
    return scan_hourly(landed).where(in_zips(zips))


def scan_spatial_zip(landed: DataFrame, zips: list[str]) -> DataFrame:
    spatial = scan_daily(landed, measures=SPATIAL_ZIP_MEASURES)
    return spatial.where((F.col("provider_type") == "spatial") & in_zips(zips))


def scan_geo_zip(landed: DataFrame, zips: list[str]) -> DataFrame:
    """Zip scan whose source was chosen by the remote service."""
    return scan_daily(landed, measures=SPATIAL_ZIP_MEASURES).where(in_zips(zips))


def _at_targets(landed: DataFrame, targets: DataFrame, field: str) -> DataFrame:
    records = scan_daily(landed, measures=SPATIAL_POINT_MEASURES)
    return records.join(targets.select(F.col(field)), field, "left_semi")


def scan_by_coordinate(landed: DataFrame, targets: DataFrame) -> DataFrame:
    """Records at the points named by the ``Coordinate`` texts of ``targets``."""
    return _at_targets(landed, targets, "Coordinate")


def scan_by_address(landed: DataFrame, targets: DataFrame) -> DataFrame:
    return _at_targets(landed, targets, "Address")


def _has_bad_value(providers: Column) -> Column:
    """Does any record hold a measurement text that is not a strict number?"""
    def bad(record):
        found = F.lit(False)
        for name in DAILY_MEASURES:
            text = record[name]["Value"]
            found = found | (text.isNotNull() & ~measures.is_strict_number(text))
        return found

    none = F.array().cast(f"array<{STRICT_RECORD}>")
    return F.exists(providers, lambda p: F.exists(F.coalesce(p["Records"], none), bad))


def _undelivered(landed: DataFrame) -> Column:
    """Why a parsed response holds no records that any scan could read."""
    bodiless = F.col("no_body") if _is_parsed(landed) else F.col("body").isNull()
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(bodiless, "no body")
        .when(F.col(f"_response.{CORRUPT}").isNotNull(), "malformed body")
        .when(F.col("_response.Data.Providers").isNull(), "no providers")
    )


def scan_rejects(
    landed: DataFrame, identity=DAILY_IDENTITY, measures=DAILY_MEASURES,
) -> DataFrame:
    """Responses the scans get nothing from, with the reason; takes their arguments."""
    return (
        parse(landed, record_schema(identity, measures))
        .withColumn("reject", F.explode(F.array(_undelivered(landed))))
        .where(F.col("reject").isNotNull())
        .select("request_id", "station_id", "reject")
    )


def with_reject(landed: DataFrame) -> DataFrame:
    """Parse strictly and name why a whole response is refused, null if it is fine."""
    if _is_parsed(landed):
        unquoted, bad_value = F.col("unquoted"), F.col("bad_value")
    else:
        unquoted = _is_unquoted(F.col("body"))
        bad_value = _has_bad_value(F.col("_response.Data.Providers"))
    reason = (
        _undelivered(landed)
        .when(unquoted, "value is not quoted")
        .when(bad_value, "value is not a number")
    )
    return parse(landed, STRICT_RECORD).withColumn("reject", F.explode(F.array(reason)))


def strict_records(landed: DataFrame, *keep: str) -> DataFrame:
    """Strict scan in one pass: a row per record of each accepted response.

    A refused or empty response gives one row whose ``Date`` is null, so its
    outcome is not lost and no second parse is needed to report it.
    """
    keys = ("station_id", *keep, "reject")
    accepted = F.when(F.col("reject").isNull(), F.col("_response.Data.Providers"))
    return (
        with_reject(landed)
        .select(*keys, F.explode_outer(accepted).alias("_p"))
        .select(*keys, F.explode_outer("_p.Records").alias("_r"))
        .select(*keys, "_r.*")
    )


def scan_daily_strict(landed: DataFrame, *keep: str) -> DataFrame:
    """Records of the accepted responses."""
    return strict_records(landed, *keep).where(F.col("Date").isNotNull()).drop("reject")


def strict_rejects(landed: DataFrame) -> DataFrame:
    """Refused responses with their reason."""
    return (
        with_reject(landed)
        .where(F.col("reject").isNotNull())
        .select("request_id", "station_id", "reject")
    )
