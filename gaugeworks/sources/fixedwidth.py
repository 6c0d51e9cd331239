"""Fixed-width little-endian records, as columns and as files.

Files hold whole records and nothing else, and are filed under year and station
group.  The last byte of a record is always zero.  That byte is written as the line
separator of a text file, so that tasks write record files with the engine's own
writer and its commit.  An index has a row per folder with the stations and times
found when the files were read back; a range query opens only folders that can hold
its rows, and files of any size are read in splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.functions import dates
from gaugeworks.operators.series import numbered
from gaugeworks.schemas import RECORD_WIDTH
from gaugeworks.sources.store import listed, station_group

# Field, byte width and signedness, in record order.
LAYOUT = {
    "daily": (
        ("ts", 4, False), ("station_id", 2, False), ("temperature", 2, True),
        ("et", 2, True), ("wind_speed", 2, False), ("humidity", 1, False),
        ("solar_radiation", 1, False), ("qc_flags", 1, False),
    ),
    "hourly": (
        ("ts", 4, False), ("station_id", 2, False), ("temperature", 2, True),
        ("et", 2, True), ("wind_speed", 2, False), ("wind_direction", 1, False),
        ("humidity", 1, False), ("solar_radiation", 2, False),
        ("precipitation", 2, False), ("vapor_pressure", 2, False), ("qc_flags", 1, False),
    ),
}


def bounds(width: int, signed: bool) -> tuple[int, int]:
    """Least and largest number of a field."""
    span = 1 << (8 * width)
    return (-span // 2, span // 2 - 1) if signed else (0, span - 1)


def misfit(kind: str) -> Column:
    """The first field that is missing or does not fit its width, or null."""
    return F.coalesce(*(
        F.when(~F.coalesce(F.col(name).between(*bounds(width, signed)), F.lit(False)), F.lit(name))
        for name, width, signed in LAYOUT[kind]
    ))


def fits(kind: str) -> Column:
    """Does every field of the row fit its width?"""
    return misfit(kind).isNull()


def rejects(obs: DataFrame, kind: str) -> DataFrame:
    """Rows that no record can hold, with the first field that does not fit."""
    return obs.withColumn("field", misfit(kind)).where(F.col("field").isNotNull())


# One character per byte, so that texts stand for bytes until the last step.
_BYTES = "ISO-8859-1"


def _record_text(kind: str) -> Column:
    """The packed record, one character per byte, each field lowest byte first."""
    used = sum(width for _, width, _ in LAYOUT[kind])
    parts = [
        F.char(F.shiftright(F.col(name).cast("bigint"), 8 * i).bitwiseAND(F.lit(255)))
        for name, width, _ in LAYOUT[kind] for i in range(width)
    ]
    return F.concat(*parts, *[F.char(F.lit(0))] * (RECORD_WIDTH[kind] - used))


def pack(obs: DataFrame, kind: str) -> DataFrame:
    """Add the packed record; rows with a field out of range get null."""
    return obs.withColumn("record", F.when(fits(kind), F.encode(_record_text(kind), _BYTES)))


def pack_blocks(obs: DataFrame, kind: str, order: list[str], rows: int = 4096) -> DataFrame:
    """Records of each station in order, joined into payloads of at most ``rows``;
    fields that the order does not name break its ties."""
    fields = [name for name, _, _ in LAYOUT[kind]]
    by = [*order, *(f for f in fields if f not in (*order, "station_id"))]
    kept = obs.where(fits(kind)).select(*dict.fromkeys(["station_id", *by]))
    placed = numbered(kept, ["station_id"], by, "_position").withColumn("_text", _record_text(kind))
    item = F.struct("_position", "_text")
    joined = F.array_join(F.transform("_items", lambda i: i["_text"]), "")
    return (
        placed.groupBy("station_id", F.floor((F.col("_position") - 1) / rows).alias("block"))
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select("station_id", "block", F.encode(joined, _BYTES).alias("content"))
    )


def read_payloads(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "content")
    )


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole records of files that hold nothing else, one per row.

    A payload row carries its file in one piece, which suits chunk files; this
    scan cuts files of any size into splits at record boundaries.  ``path`` may
    name several places, with commas between them.
    """
    records = spark._jsc.sc().binaryRecords(
        path, RECORD_WIDTH[kind], spark._jsc.hadoopConfiguration())
    encoder = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    return DataFrame(spark._jsparkSession.createDataset(records, encoder), spark).toDF("content")


def _number(text: Column, offset: int, width: int, signed: bool) -> Column:
    """Little-endian number of ``width`` bytes in a record text."""
    code = lambda i: F.ascii(F.substring(text, offset + i + 1, 1)).cast("bigint")
    value = sum((F.shiftleft(code(i), 8 * i) for i in range(1, width)), code(0))
    if signed:
        half = 1 << (8 * width - 1)
        value = F.when(value >= half, value - 2 * half).otherwise(value)
    return value


def unpack(payloads: DataFrame, kind: str) -> DataFrame:
    """One row per whole record of each payload; a trailing partial one is ignored."""
    width = RECORD_WIDTH[kind]
    keep = [c for c in payloads.columns if c not in ("content", "length")]
    last = F.floor(F.length("content") / width).cast("int") - 1
    record = F.substring(F.col("content"), F.col("record_no") * width + 1, F.lit(width))
    rows = (
        payloads.where(F.length("content") >= width)
        .withColumn("record_no", F.explode(F.sequence(F.lit(0), last)))
        # The generator decodes a record once for all of its fields.
        .select(*keep, "record_no", F.explode(F.array(F.decode(record, _BYTES))).alias("_text"))
    )
    fields, offset = [], 0
    for name, size, signed in LAYOUT[kind]:
        field = _number(F.col("_text"), offset, size, signed)
        # An unsigned 4-byte count may not fit an INT.
        fields.append((field if size == 4 else field.cast("int")).alias(name))
        offset += size
    return rows.select(*keep, "record_no", *fields)


def with_time(records: DataFrame, kind: str) -> DataFrame:
    """Add the date or time and the year to unpacked records."""
    if kind == "daily":
        timed = records.withColumn("obs_date", dates.days_to_date(F.col("ts").cast("int")))
        return timed.withColumn("year", F.year("obs_date"))
    timed = records.withColumn("obs_ts", dates.hours_to_timestamp(F.col("ts").cast("int")))
    return timed.withColumn("year", F.year("obs_ts"))


INDEX = (
    "year INT, station_group INT, row_count BIGINT, min_station INT, max_station INT, min_ts BIGINT, max_ts BIGINT"
)


def write_packed(obs: DataFrame, root: str, kind: str) -> None:
    """Write rows as record files below ``root``, those that do not fit as a table with
    the field that refuses them, and the index of what can be read back."""
    text = F.encode(_record_text(kind), _BYTES)
    body = F.substring(text, 1, RECORD_WIDTH[kind] - 1).cast("string")
    placed = obs.where(fits(kind)).select(
        "year", station_group(F.col("station_id")).alias("station_group"), "station_id", "ts", body.alias("value"))
    (
        placed.hint("rebalance", "year", "station_group")
        .sortWithinPartitions("year", "station_group", "station_id", "ts")
        .select("year", "station_group", "value")
        .write.mode("overwrite")
        .partitionBy("year", "station_group")
        .option("lineSep", "\0")
        .text(f"{root}/records")
    )
    rejects(obs, kind).write.mode("overwrite").parquet(f"{root}/rejects")
    written = _contents(obs.sparkSession, listed(obs.sparkSession, f"{root}/records/year=*/station_group=*"), kind)
    found = with_time(unpack(written, kind), kind)
    found.groupBy("year", station_group(F.col("station_id")).alias("station_group")).agg(
        F.count("*").alias("row_count"), F.min("station_id").alias("min_station"),
        F.max("station_id").alias("max_station"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
    ).write.mode("overwrite").parquet(f"{root}/index")


def _contents(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Records of all files in some folders."""
    return read_records(spark, ",".join(paths), kind) if paths else spark.createDataFrame([], "content BINARY")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_packed(
    spark: SparkSession, root: str, kind: str, station: int | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Rows of the record files in the folders that can hold a station's rows from
    ``start`` up to but not including ``end``, and of those only such rows; bounds
    that are not given hold for all."""
    folders = read_index(spark, root)
    wanted = F.lit(True)
    if station is not None:
        folders = folders.where(F.lit(station).between(F.col("min_station"), F.col("max_station")))
        wanted = wanted & (F.col("station_id") == station)
    if start is not None:
        first = dates.ts_of(start, kind)
        folders, wanted = folders.where(F.col("max_ts") >= first), wanted & (F.col("ts") >= first)
    if end is not None:
        last = dates.ts_of(end, kind)
        folders, wanted = folders.where(F.col("min_ts") < last), wanted & (F.col("ts") < last)
    # A path a folder, of which there is one a year and station group.
    chosen = folders.select("year", "station_group").collect()
    paths = sorted(f"{root}/records/year={r['year']}/station_group={r['station_group']}" for r in chosen)
    rows = unpack(_contents(spark, paths, kind), kind).drop("record_no").where(wanted)
    return with_time(rows.withColumn("ts", F.col("ts").cast("int")), kind)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rejects")
