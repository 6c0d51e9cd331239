"""Store, catalog, integrity and incremental ingest."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import integrity, lookups, ranges, reports, stats
from gaugeworks.schemas import DAILY_COLUMNS, LANDED
from gaugeworks.sources import store
from gaugeworks.streaming import delivery, ingest
from test_responses import body, day

DAYS = "station_id int, ts int, temperature int"


def obs(spark, rows):
    """Daily rows of ``(station, date, temperature)``."""
    made = [(s, (dt.date.fromisoformat(d) - dt.date(1985, 1, 1)).days, t) for s, d, t in rows]
    date = F.date_add(F.lit("1985-01-01").cast("date"), F.col("ts"))
    return spark.createDataFrame(made, DAYS).select(
        "station_id", F.year(date).alias("year"), "ts", date.alias("obs_date"), "temperature",
        F.lit(420).alias("et"), F.lit(15).alias("wind_speed"), F.lit(64).alias("humidity"),
        F.lit(22).alias("solar_radiation"), F.lit(0).alias("qc_flags"))


def eleven(spark):
    return obs(spark, [(2, f"2024-01-{15 + i}", 200 + i) for i in range(11)])


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_write_then_query(spark, root):
    store.write_obs(eleven(spark), root, "daily", "a")
    stored = store.read_obs(spark, root, "daily")
    rows = ranges.query_range(stored, "daily", 2, "2024-01-01", "2024-02-01")
    assert ranges.query_count(rows).first()[0] == 11
    assert [r["temperature"] for r in ranges.preview(rows, "ts").collect()] == list(range(200, 210))
    # The end day is not part of the range.
    assert ranges.query_range(stored, "daily", 2, "2024-01-15", "2024-01-25").count() == 10
    assert ranges.query_range(stored, "daily", 3, "2024-01-01", "2024-02-01").isEmpty()
    assert ranges.recent_days(stored, "daily", "2024-01-18", 2).count() == 2
    diff = integrity.readback_diff(eleven(spark), stored).first()
    assert tuple(diff) == (11, 11, 0, 0)


def test_empty_store_has_no_data(spark, root):
    rows = ranges.query_range(store.read_obs(spark, root, "daily"), "daily", 2, "2024-01-01", "2024-02-01")
    assert rows.isEmpty() and set(DAILY_COLUMNS) <= set(rows.columns)
    assert store.read_catalog(spark, root).isEmpty()


def test_range_query_prunes_folders_and_pushes_bounds(spark, root):
    store.write_obs(obs(spark, [(s, f"{y}-05-01", 1) for s in (2, 600) for y in (2022, 2023, 2024)]), root, "daily", "a")
    rows = ranges.query_range(store.read_obs(spark, root, "daily"), "daily", 2, "2023-01-01", "2023-12-31")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "station_group" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(station_id,2)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_each_ingest_replaces_only_its_own_rows(spark, root):
    store.write_obs(eleven(spark), root, "daily", "a")
    store.write_obs(obs(spark, [(5, "2024-03-01", 1)]), root, "daily", "b")
    store.write_obs(obs(spark, [(5, "2024-03-01", 2), (5, "2024-03-02", 3)]), root, "daily", "b")
    stored = store.read_obs(spark, root, "daily")
    assert stored.where("station_id = 2").count() == 11
    assert sorted(r["temperature"] for r in stored.where("station_id = 5").collect()) == [2, 3]


def test_files_are_sorted_by_station_and_time(spark, root):
    import pyarrow.parquet as pq

    rows = [(s, f"2024-01-{d:02d}", d) for d in range(28, 0, -1) for s in (9, 3, 200)]
    store.write_obs(obs(spark, rows), root, "daily", "a", level=9)
    files = list(Path(root).rglob("*.parquet"))
    assert len(files) == 1
    table = pq.read_table(files[0]).to_pydict()
    keys = list(zip(table["station_id"], table["ts"]))
    assert keys == sorted(keys)


def test_a_crowded_folder_is_split_over_files(spark, root):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        crowd = spark.range(0, 200_000, 1, 16).select(
            F.lit(2).alias("station_id"), (F.col("id") % 300 + 14000).cast("int").alias("ts"),
            F.col("id").cast("int").alias("temperature"))
        date = F.date_add(F.lit("1985-01-01").cast("date"), F.col("ts"))
        zero = [F.lit(0).alias(c) for c in ("et", "wind_speed", "humidity", "solar_radiation", "qc_flags")]
        store.write_obs(crowd.select("station_id", F.lit(2023).alias("year"), "ts", date.alias("obs_date"),
                                     "temperature", *zero), root, "daily", "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(root).rglob("*.parquet"))) > 1
    stored = store.read_obs(spark, root, "daily")
    assert stored.count() == 200_000 and stored.agg(F.sum("temperature")).first()[0] == 199_999 * 100_000


def test_catalog_and_stats(spark, root):
    store.write_obs(eleven(spark).unionByName(obs(spark, [(5, "2023-01-01", -10), (5, "2024-01-01", 30)])), root, "daily", "a")
    store.write_catalog(spark, root, "daily", "a")
    catalog = store.read_catalog(spark, root)
    got = {(r["station_id"], r["year"]): r["row_count"] for r in catalog.collect()}
    assert got == {(2, 2024): 11, (5, 2023): 1, (5, 2024): 1}
    sizes = sum(f.stat().st_size for f in Path(root, "data_type=daily").rglob("*.parquet"))
    assert catalog.agg(F.sum("stored_bytes")).first()[0] == pytest.approx(sizes)
    stations = spark.createDataFrame([("True",), ("False",)], "IsActive string")
    total = stats.store_stats(catalog, stations).first()
    assert (total["station_count"], total["active_station_count"], total["chunk_count"], total["total_rows"]) == (2, 1, 3, 13)
    assert ranges.chunk_select(catalog, 5, 2022, 2023, "daily").count() == 1
    plan = spark.createDataFrame([(2, 2024, "daily"), (2, 2023, "daily"), (7, 2024, "daily")], "station_id int, year int, data_type string")
    assert sorted(tuple(r) for r in lookups.pending_chunks(plan, catalog).collect()) == [(2, 2023, "daily"), (7, 2024, "daily")]
    daily = stats.daily_stats(store.read_obs(spark, root, "daily"), "station_id").where("station_id = 5").first()
    assert (daily["min_temp"], daily["max_temp"], daily["avg_temp"], daily["total_et"], daily["record_count"]) == (-1.0, 3.0, 1.0, 8.4, 2)


def test_daily_stats_of_nothing_has_no_row(spark):
    assert stats.daily_stats(eleven(spark).where("false"), "station_id").isEmpty()


def test_verify_reports_damage(spark, root):
    rows = [(s, f"{y}-05-{d:02d}", d) for s in (2, 600) for y in (2022, 2023, 2024) for d in range(1, 29)]
    store.write_obs(obs(spark, rows), root, "daily", "a")
    store.write_catalog(spark, root, "daily", "a")
    verified = integrity.verify_files(spark, root, "daily")
    assert integrity.verify_summary(verified).first().asDict() == {"verified": 6, "failed": 0}
    files = sorted(Path(root, "data_type=daily").rglob("*.parquet"))
    files[0].write_bytes(b"not a parquet file")
    files[1].unlink()
    whole = bytearray(files[2].read_bytes())
    whole[20:60] = b"\x00" * 40
    files[2].write_bytes(whole)
    for crc in Path(root).rglob(".*.crc"):
        crc.unlink()
    (files[3].parent / "junk.parquet").write_bytes(b"junk")
    (files[3].parent / "notes.txt").write_text("not a chunk")
    by_error = {}
    for r in integrity.verify_files(spark, root, "daily").collect():
        by_error.setdefault(r["error"], []).append(r["file"])
    assert len(by_error[None]) == 3
    assert len(by_error["file is gone"]) == 1
    assert sum(len(v) for k, v in by_error.items() if k) == 4
    # A read ends at the damage, unless it is told to skip; what it skips is listed.
    with pytest.raises(Exception):
        store.read_obs(spark, root, "daily").collect()
    skipped = {r["file"] for r in integrity.skipped_files(spark, root, "daily").collect()}
    assert skipped == {f for k, files in by_error.items() if k for f in files}
    stored = store.read_obs(spark, root, "daily", tolerant=True)
    assert len(stored.collect()) == 28 * 3
    assert lookups.missing_chunks(store.read_catalog(spark, root), stored, "daily").count() == 3
    written = integrity.nonempty_files(spark, root, "daily").groupBy("written").count().collect()
    assert {r["written"]: r["count"] for r in written} == {True: 5, False: 1}


def test_verify_sees_equal_rows_swapped(spark, root):
    pair = lambda t: obs(spark, [(2, "2024-05-01", t), (2, "2024-05-01", t)])
    store.write_obs(pair(10), root, "daily", "a")
    store.write_catalog(spark, root, "daily", "a")
    store.write_obs(pair(99), root, "daily", "a")
    catalog = store.read_files(spark, root).first()["file"]
    (stored,) = Path(root, "data_type=daily").rglob("*.parquet")
    stored.rename(Path(root, catalog))
    for crc in Path(root).rglob(".*.crc"):
        crc.unlink()
    (row,) = integrity.verify_files(spark, root, "daily").collect()
    assert (row["ok"], row["error"]) == (False, "rows differ")


def test_verify_sees_a_flipped_byte_that_still_decodes(spark, root):
    """A page's checksum tells damage where the values decode and would only differ."""
    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    rows = [(2, f"2024-05-{d:02d}", 1000 + 37 * d * d) for d in range(1, 29)]
    placed = obs(spark, rows).drop("obs_date").withColumn("station_group", F.lit(0))
    folder = f"{root}/data_type=daily/ingest_id=a"
    # Plain pages without compression, so that a value can be changed in place.
    placed.coalesce(1).write.partitionBy("year", "station_group").option("compression", "none").option(
        "parquet.enable.dictionary", False).parquet(folder)
    store.write_catalog(spark, root, "daily", "a")
    assert integrity.verify_files(spark, root, "daily").first()["ok"]
    (file,) = Path(folder).rglob("*.parquet")
    whole, value = bytearray(file.read_bytes()), (1000 + 37 * 25).to_bytes(4, "little")
    assert whole.count(value) == 1
    whole[whole.index(value)] ^= 1
    file.write_bytes(whole)
    for crc in Path(root).rglob(".*.crc"):
        crc.unlink()
    assert sorted(pq.read_table(file)["temperature"].to_pylist()) != sorted(t for *_, t in rows)
    # The changed value decodes, and a read that does not look at checksums takes it.
    assert store.read_obs(spark, root, "daily").count() == 28
    (row,) = integrity.verify_files(spark, root, "daily").collect()
    assert (row["ok"], row["error"], row["rows_read"]) == (False, "file cannot be read", 0)


def test_differences_are_located(spark):
    rows = [(s, f"{y}-0{m}-{d:02d}", s + d) for s in (2, 3, 600) for y in (2023, 2024) for m in (1, 6) for d in range(1, 20)]
    written = obs(spark, rows + [(2, "2024-01-05", 500)] * 2)
    changed = [r for r in rows if r != (3, "2023-06-07", 10)] + [(600, "2024-01-09", 777), (2, "2024-01-05", 500)]
    read = obs(spark, changed)
    got = {(r["station_id"], str(r["obs_date"]), r["temperature"], r["side"], r["times"])
           for r in integrity.located_diff(written, read).collect()}
    assert got == {(3, "2023-06-07", 10, "written", 1), (600, "2024-01-09", 777, "read", 1),
                   (2, "2024-01-05", 500, "written", 1)}
    assert integrity.located_diff(written, written).isEmpty()
    assert integrity.located_diff(written.limit(0), written.limit(0)).isEmpty()
    assert integrity.located_diff(written.limit(0), read).agg(F.sum("times")).first()[0] == len(changed)


def test_rows_of_equal_parts_are_not_shuffled(spark, tmp_path):
    whole = spark.range(300_000).select(
        (F.col("id") % 40).cast("int").alias("station_id"), (F.col("id") % 5000 + 3000).cast("int").alias("ts"),
        F.col("id").cast("int").alias("temperature"))
    date = F.date_add(F.lit("1985-01-01").cast("date"), F.col("ts"))
    whole.withColumn("year", F.year(date)).write.parquet(str(tmp_path / "w"))
    written = spark.read.parquet(str(tmp_path / "w"))
    read = written.withColumn("temperature", F.when(F.col("temperature") == 77_777, 0).otherwise(F.col("temperature")))
    found = integrity.located_diff(written, read)
    assert sorted((r["temperature"], r["side"]) for r in found.collect()) == [(0, "read"), (77_777, "written")]
    # Row counts of the exchanges that ran: checksums per part, then the rows of one part.
    plan, rows = found._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "ShuffleExchange" in node.getClass().getName():
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = node.getClass().getSimpleName()
        if inner == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif inner.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    assert rows and max(rows) < 30_000, rows


def test_verify_names_unrecorded_files(spark, root):
    store.write_obs(eleven(spark), root, "daily", "a")
    (row,) = integrity.verify_files(spark, root, "daily").collect()
    assert (row["rows_read"], row["error"]) == (11, "file is not recorded")


def test_readback_diff_counts_repeats(spark):
    a = eleven(spark).unionByName(obs(spark, [(2, "2024-01-15", 200)]))
    b = eleven(spark).unionByName(obs(spark, [(3, "2024-01-15", 1), (3, "2024-01-15", 1)]))
    assert tuple(integrity.readback_diff(a, b).first()) == (12, 13, 1, 2)


def test_csv_export(spark, root):
    reports.export_csv(eleven(spark).select("station_id", "obs_date", "temperature"), root)
    lines = "".join(f.read_text() for f in Path(root).glob("*.csv")).splitlines()
    assert "2,2024-01-15,200" in lines and "station_id,obs_date,temperature" in lines


def land(folder, name, *rows):
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = ("request_id", "landed_seq", "station_id", "error", "body")
    Path(folder, name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


def test_stream_ingest_stores_each_station_year_once(spark, tmp_path, root):
    landing, progress = str(tmp_path / "landing"), str(tmp_path / "progress")
    run = lambda: ingest.ingest_stream(spark, landing, root, progress).awaitTermination()
    land(landing, "1.json",
         ("a", 1, 2, None, body([day("2024-01-15", temp="10")])),
         ("a", 1, 2, None, body([day("2024-01-16", temp="10")])),
         ("b", 2, 2, None, body([day("2024-01-15", temp="20"), day("2023-12-31", temp="20")])),
         ("c", 0, 5, None, body([day("2024-01-15")])),
         ("c", 0, 5, None, '{"Data": {}}'),
         ("d", 3, 7, "status 502", None))
    run()
    stored = lambda: sorted(
        (r["station_id"], str(r["obs_date"]), r["temperature"]) for r in store.read_obs(spark, root, "daily").collect())
    first = [(2, "2023-12-31", 200), (2, "2024-01-15", 100), (2, "2024-01-16", 100)]
    assert stored() == first
    run()
    assert stored() == first
    land(landing, "2.json",
         ("e", 9, 2, None, body([day("2024-05-01")])),
         ("f", 8, 5, None, body([day("2024-01-15", temp="30")])))
    run()
    assert stored() == first + [(5, "2024-01-15", 300)]
    log = spark.read.parquet(f"{root}/fetch_log").select("request_id", "records", "success", "error").collect()
    assert {tuple(r) for r in log} == {
        ("a", 2, True, None), ("b", 1, True, None), ("c", 0, False, "no providers"),
        ("d", 0, False, "status 502"), ("e", 0, True, None), ("f", 1, True, None)}


def test_a_repeated_batch_rebuilds_its_own_rows(spark, root):
    rows = spark.createDataFrame([("a", 1, 2, None, body([day("2024-01-15"), day("2024-01-16")]))], LANDED)
    for _ in range(2):
        ingest.ingest_batch(rows, root, "batch-000000000")
        assert store.read_obs(spark, root, "daily").count() == 2
        assert store.read_catalog(spark, root).count() == 1
    ingest.ingest_batch(rows, root, "batch-000000001")
    assert store.read_obs(spark, root, "daily").count() == 2


def test_dry_run_writes_no_observations(spark, root):
    rows = spark.createDataFrame([("a", 1, 2, None, body([day("2024-01-15")]))], LANDED)
    ingest.ingest_batch(rows, root, "x", dry_run=True)
    assert not Path(root, "data_type=daily").exists()
    assert spark.read.parquet(f"{root}/fetch_log").first()["records"] == 1


def delivered(folder, name, *pages):
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = ("request_id", "landed_seq", "station_id", "error", "body", "landed_at")
    Path(folder, name).write_text("\n".join(json.dumps(dict(zip(names, p))) for p in pages))


def test_repeated_deliveries_are_taken_once(spark, tmp_path):
    """Three runs from one checkpoint: repeats within the delay go, in a batch and later."""
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))

    def run():
        delivery.deliver_once(spark, landing, out, progress, "2 days", files_per_batch=1).awaitTermination()
        return sorted((r["request_id"], r["body"]) for r in spark.read.parquet(out).collect())

    a, b = ("a", 1, 2, None, "x"), ("b", 2, 2, "status 502", None)
    delivered(landing, "1.json", (*a, "2024-01-01T00:00:00Z"), (*a, "2024-01-01T01:00:00Z"), (*b, "2024-01-01T02:00:00Z"))
    assert run() == [("a", "x"), ("b", None)]
    # Another page of the same request is another page; the same one again is not.
    delivered(landing, "2.json", (*a, "2024-01-02T00:00:00Z"), ("a", 1, 2, None, "y", "2024-01-02T00:00:00Z"))
    assert run() == [("a", "x"), ("a", "y"), ("b", None)]
    delivered(landing, "3.json", (*b, "2024-01-02T12:00:00Z"), ("c", 3, 5, None, "z", "2024-01-09T00:00:00Z"))
    assert run() == [("a", "x"), ("a", "y"), ("b", None), ("c", "z")]
    # Beyond the delay a page that is too late is dropped, and state has been let go.
    delivered(landing, "4.json", ("late", 4, 5, None, "w", "2024-01-01T00:00:00Z"), (*a, "2024-01-09T01:00:00Z"))
    assert run() == [("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("c", "z")]
    assert run() == [("a", "x"), ("a", "x"), ("a", "y"), ("b", None), ("c", "z")]


def test_timing_sketches_merge(spark):
    import random

    rng = random.Random(3)
    log = [(i, i % 5, i % 9 != 0, *(int(rng.expovariate(0.01)) + k for k in range(len(stats.PHASES)))) for i in range(20_000)]
    frame = spark.createDataFrame(log, "ordinal int, ingest_id int, success boolean, "
                                  + ", ".join(f"{p} bigint" for p in stats.PHASES))
    sketches = stats.timing_sketches(frame, "ingest_id")
    assert sketches.count() == 5 * len(stats.PHASES)
    got = {r["phase"]: r for r in stats.merged_percentiles(sketches, p50=0.5, p99=0.99, p0=0.0, p100=1.0).collect()}
    for k, phase in enumerate(stats.PHASES):
        values = sorted(r[3 + k] for r in log if r[2])
        row, n = got[phase], len(values)
        assert row["fetches"] == n and (row["p0"], row["p100"]) == (values[0], values[-1])
        for name, rank in (("p50", 0.5), ("p99", 0.99)):
            low, high = (values[max(0, min(n - 1, round((rank + e) * n)))] for e in (-stats.RANK_ERROR, stats.RANK_ERROR))
            assert low <= row[name] <= high
    assert stats.merged_percentiles(stats.timing_sketches(frame.limit(0), "ingest_id"), p50=0.5).isEmpty()


def test_checksums_are_exact_and_paths_cut_per_chunk(spark, root):
    rows = obs(spark, [(s, f"2024-01-{15 + i}", 200 + i) for s in (2, 300) for i in range(11)])
    store.write_obs(rows, root, "daily", "a")
    chunks = store.chunk_files(spark, root, "daily")
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract" in line for line in plan.splitlines()[1:])
    stored = [c for c in DAILY_COLUMNS if c != "obs_date"]
    hashes = [r["h"] for r in rows.select(F.xxhash64(*stored).alias("h")).collect()]
    assert min(hashes) < 0 < max(hashes)
    assert sum(int(r["checksum"]) for r in chunks.collect()) == sum(hashes)
