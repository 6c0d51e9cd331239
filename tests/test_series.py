"""Ordered computations: segments of any span give the rows of whole stations."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import series
from gaugeworks.sources import fixedwidth

ROWS = 4000


@pytest.fixture(scope="module")
def readings(spark):
    """One station holds most rows; keys are unique, values repeat."""
    draw = random.Random(7)
    rows = [(2 if draw.random() < 0.7 else draw.randrange(3, 9), draw.randrange(300), i,
             draw.randrange(-500, 600), draw.randrange(3)) for i in range(ROWS)]
    return spark.createDataFrame(rows, "station_id int, ts int, id int, temperature int, qc_flags int").cache()


def brute(readings):
    ordered = {}
    for r in sorted(readings.collect(), key=lambda r: (r["station_id"], r["ts"], r["id"])):
        ordered.setdefault(r["station_id"], []).append(r)
    return ordered


@pytest.mark.parametrize("span", [10 ** 9, 64, 1])
def test_delta_and_back(spark, readings, span):
    order = ["ts", "id"]
    deltas = series.delta_columns(readings, ["temperature"], order, span=span)
    expected = {}
    for rows in brute(readings).values():
        before = 0
        for r in rows:
            expected[r["id"]] = r["temperature"] - before
            before = r["temperature"]
    assert {r["id"]: r["d_temperature"] for r in deltas.collect()} == expected
    back = series.undo_delta(deltas, ["temperature"], order, span=span)
    assert {r["id"]: r["temperature"] for r in back.collect()} == {
        r["id"]: r["temperature"] for r in readings.collect()}


@pytest.mark.parametrize("span", [10 ** 9, 64, 1])
def test_runs(spark, readings, span):
    got = series.value_runs(readings, "qc_flags", ["ts", "id"], span=span).collect()
    expected = set()
    for station, rows in brute(readings).items():
        runs = []
        for r in rows:
            if runs and runs[-1][0] == r["qc_flags"]:
                runs[-1][1] += 1
            else:
                runs.append([r["qc_flags"], 1])
        expected |= {(station, i + 1, value, n) for i, (value, n) in enumerate(runs)}
    assert {tuple(r) for r in got} == expected
    assert sum(r["run_length"] for r in got) == ROWS


def test_documented_run_example(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 0, 1, 1, 1])], "station_id int, ts int, v int")
    runs = series.value_runs(rows, "v", ["ts"]).orderBy("run_no").collect()
    assert [(r["value"], r["run_length"]) for r in runs] == [(0, 3), (1, 3)]


def packed_rows(spark, kind):
    if kind == "daily":
        rows = [(14258, 2, -53, -1, 65535, 255, 255, 3), (14259, 65535, 32767, -32768, 0, 0, 0, 255), (0, 1, 0, 0, 0, 100, 1, 0)]
    else:
        rows = [(342193, 2, -53, -1, 65535, 180, 255, 65535, 1, 2, 1), (2 ** 31 - 1, 65535, 32767, -32768, 0, 0, 0, 0, 65535, 65535, 255)]
    names = [n for n, _, _ in fixedwidth.LAYOUT[kind]]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names, rows


@pytest.mark.parametrize("kind", ["daily", "hourly"])
def test_pack_then_unpack_files(spark, tmp_path, kind):
    import struct

    frame, names, rows = packed_rows(spark, kind)
    records = {r["ts"]: bytes(r["record"]) for r in fixedwidth.pack(frame, kind).collect()}
    layout = "<IHhhHBBBx" if kind == "daily" else "<IHhhHBBHHHBxxx"
    expected = [struct.pack(layout, *r) for r in rows]
    assert [records[r[0]] for r in rows] == expected
    (tmp_path / "whole.bin").write_bytes(b"".join(expected))
    (tmp_path / "partial.bin").write_bytes(expected[0] + b"\xff" * 7)
    (tmp_path / "short.bin").write_bytes(b"\xff" * 7)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(expected[0])
    got = fixedwidth.unpack(fixedwidth.read_payloads(spark, str(tmp_path)), kind)
    by_file = {}
    for r in got.orderBy("path", "record_no").collect():
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r[n] for n in names))
    assert by_file == {"whole.bin": rows, "partial.bin": rows[:1]}


@pytest.mark.parametrize("kind", ["daily", "hourly"])
def test_large_files_are_read_in_splits(spark, tmp_path, kind):
    import struct

    layout = "<IHhhHBBBx" if kind == "daily" else "<IHhhHBBHHHBxxx"
    fields = len(fixedwidth.LAYOUT[kind]) - 2
    (tmp_path / "many.bin").write_bytes(b"".join(
        struct.pack(layout, i, i % 7, *[i % 200] * fields) for i in range(5000)))
    split, conf = "mapreduce.input.fileinputformat.split.maxsize", spark._jsc.hadoopConfiguration()
    conf.set(split, "10001")
    try:
        records = fixedwidth.read_records(spark, str(tmp_path / "many.bin"), kind)
        assert records.rdd.getNumPartitions() > 1
        got = fixedwidth.unpack(records, kind).collect()
    finally:
        conf.unset(split)
    assert sorted((r["ts"], r["station_id"], r["qc_flags"]) for r in got) == [
        (i, i % 7, i % 200) for i in range(5000)]


def test_rows_out_of_width_are_not_packed(spark):
    frame, _, _ = packed_rows(spark, "daily")
    wide = frame.withColumn("solar_radiation", F.lit(256))
    assert fixedwidth.pack(wide, "daily").where("record is not null").isEmpty()
    refused = fixedwidth.rejects(wide, "daily")
    assert refused.count() == frame.count() and refused.select("field").distinct().first()[0] == "solar_radiation"
    assert fixedwidth.rejects(frame, "daily").isEmpty()
    missing = frame.withColumn("et", F.lit(None).cast("int"))
    assert fixedwidth.rejects(missing, "daily").first()["field"] == "et"


def test_building_starts_no_job(spark, readings):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    deltas = series.delta_columns(readings, ["temperature"], ["ts", "id"])
    series.undo_delta(deltas, ["temperature"], ["ts", "id"])
    series.value_runs(readings, "qc_flags", ["ts", "id"])
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")
    assert list(jobs) == []


def test_a_hot_station_is_cut(spark, readings):
    """No group has more than the readings of a segment, whatever the station has."""
    rows = series.Segments(readings, ["station_id"], ["ts", "id"], 10)
    largest = rows.df.groupBy("_segment").count().agg(F.max("count")).first()[0]
    whole = readings.groupBy("station_id").count().agg(F.max("count")).first()[0]
    assert largest * 10 < whole


def test_null_keys_and_times(spark):
    rows = [(None, None, 1), (None, 5, 2), (None, 500, 4), (1, None, 8), (1, 70, 16)]
    frame = spark.createDataFrame(rows, "station_id int, ts int, v int")
    got = series.delta_columns(frame, ["v"], ["ts", "v"]).select("station_id", "ts", "d_v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, None, 1), (None, 5, 1), (None, 500, 2), (1, None, 8), (1, 70, 8)]))


def test_blocks_keep_order_and_bound(spark, readings):
    rows = readings.select(
        "station_id", "ts", "id", "temperature", F.lit(1).alias("et"), F.lit(2).alias("wind_speed"),
        F.lit(3).alias("humidity"), F.lit(4).alias("solar_radiation"), "qc_flags")
    blocks = fixedwidth.pack_blocks(rows, "daily", ["ts", "id"], rows=64)
    assert blocks.agg(F.max(F.length("content"))).first()[0] == 64 * 16
    back = fixedwidth.unpack(blocks, "daily").orderBy("block", "record_no")
    got = {}
    for r in back.collect():
        got.setdefault(r["station_id"], []).append((r["ts"], r["temperature"], r["qc_flags"]))
    assert got == {s: [(r["ts"], r["temperature"], r["qc_flags"]) for r in rs] for s, rs in brute(readings).items()}


def test_rows_are_shuffled_once(spark, readings, tmp_path):
    """What is carried over segments comes from the shuffle of the rows themselves."""
    readings.select("station_id", "ts", "id", "temperature", "qc_flags").write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    values, order = ["temperature"], ["ts", "id"]
    deltas = series.delta_columns(stored.drop("qc_flags"), values, [*order, *values])
    runs = series.value_runs(stored, "qc_flags", [*order, "qc_flags"])
    places = series.numbered(stored.select("station_id", *order), ["station_id"], order, "n")
    for frame in (deltas, runs, places):
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final, final
        assert final.count("Scan parquet") == 1, final


@pytest.mark.parametrize("kind", ["daily", "hourly"])
def test_record_files(spark, tmp_path, kind):
    """Files of exact records come back as the rows that fit, and rejects are the rest."""
    import random
    import struct

    rng, root = random.Random(9), str(tmp_path / "packed")
    layout = "<IHhhHBBBx" if kind == "daily" else "<IHhhHBBHHHBxxx"
    names = [n for n, _, _ in fixedwidth.LAYOUT[kind]]
    per_year = 365 * (1 if kind == "daily" else 24)
    rows = []
    for i in range(600):
        values = [rng.randint(*fixedwidth.bounds(w, s)) for _, w, s in fixedwidth.LAYOUT[kind]]
        values[0], values[1] = rng.randrange(1, 3 * per_year), rng.choice((0, 7, 255, 256, 600, 65_535))
        if i % 10 == 0:
            values[rng.randrange(2, len(values))] = rng.choice((70_000, -70_000, None))
        rows.append(tuple(values))
    frame = fixedwidth.with_time(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), kind)
    fixedwidth.write_packed(frame, root, kind)
    fit = [r for r in rows if all(v is not None and low <= v <= high for v, (low, high) in zip(
        r, (fixedwidth.bounds(w, s) for _, w, s in fixedwidth.LAYOUT[kind])))]
    assert 0 < len(fit) < len(rows)
    got = fixedwidth.read_packed(spark, root, kind)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(fit)
    assert set(got.columns) == set(frame.columns)
    refused = fixedwidth.read_rejects(spark, root)
    assert refused.count() == len(rows) - len(fit) and refused.where("field IS NULL").isEmpty()
    from pathlib import Path

    on_disk = b"".join(f.read_bytes() for f in Path(root, "records").rglob("*.txt"))
    width = struct.calcsize(layout)
    assert sorted(on_disk[i:i + width] for i in range(0, len(on_disk), width)) == sorted(
        struct.pack(layout, *r) for r in fit)
    index = fixedwidth.read_index(spark, root).collect()
    assert sum(r["row_count"] for r in index) == len(fit)
    # A range reads the folders that can hold it, and nothing else.
    some = fixedwidth.read_packed(spark, root, kind, 600, "1986-02-01", "1986-11-01")
    day = lambda text: fixedwidth.dates.ts_of(text, kind)
    assert sorted(r["ts"] for r in some.collect()) == sorted(
        r[0] for r in fit if r[1] == 600 and day("1986-02-01") <= r[0] < day("1986-11-01"))
    for folder in Path(root, "records").glob("year=*/station_group=*"):
        if folder.as_posix().rsplit("/records/")[1] != "year=1986/station_group=2":
            for file in folder.glob("*"):
                file.unlink()
    assert some.count() == fixedwidth.read_packed(spark, root, kind, 600, "1986-02-01", "1986-11-01").count()
    assert fixedwidth.read_packed(spark, root, kind, 9, "2050-01-01").isEmpty()


def test_no_record_files(spark, tmp_path):
    frame, _, _ = packed_rows(spark, "daily")
    timed = fixedwidth.with_time(frame, "daily").limit(0)
    fixedwidth.write_packed(timed.withColumn("ts", F.col("ts").cast("int")), str(tmp_path / "p"), "daily")
    assert fixedwidth.read_packed(spark, str(tmp_path / "p"), "daily").isEmpty()


def test_record_files_are_read_in_splits(spark, tmp_path):
    root = str(tmp_path / "packed")
    zero = [F.lit(0).alias(n) for n, _, _ in fixedwidth.LAYOUT["daily"][2:]]
    rows = spark.range(20_000).select((F.col("id") % 300 + 1).cast("int").alias("ts"), F.lit(5).alias("station_id"), *zero)
    fixedwidth.write_packed(fixedwidth.with_time(rows, "daily").coalesce(1), root, "daily")
    split, conf = "mapreduce.input.fileinputformat.split.maxsize", spark._jsc.hadoopConfiguration()
    conf.set(split, "50000")
    try:
        got = fixedwidth.read_packed(spark, root, "daily")
        assert got.rdd.getNumPartitions() >= 6 and got.count() == 20_000
    finally:
        conf.unset(split)
