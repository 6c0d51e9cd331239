"""Registered queries over tables of a few rows."""

import datetime as dt
from decimal import Decimal

from gaugeworks.plans import QUERIES, adapters

LINES = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity decimal(15,2), "
         "l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string, l_shipdate date")


def line(order, part, station=5):
    return (order, part, station, 1, Decimal(17), Decimal("0.04"), Decimal("0.02"), "N", dt.date(1997, 5, order))


def test_daily_range_has_rows_the_store_refuses(spark, tmp_path):
    """Humidity is the part's number, and no more than 100 is valid."""
    spark.createDataFrame([line(6, 50), line(7, 110), line(8, 50, 6)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["query_daily_range"](spark, str(tmp_path)).collect()
    assert sorted((r["station_id"], r["humidity"]) for r in rows) == [(5, 50), (5, 110)]


def test_every_customer_has_a_place(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (9, 0, 4, 300_000, 7)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["batch_ordered"](spark, str(tmp_path)).collect()
    assert [(r["ordinal"], r["place"]) for r in rows] == [(0, 0), (4, 1), (7, 2), (9, 3), (300_000, 4)]


def test_ingested_pages_leave_no_landing(spark, tmp_path):
    """The landed texts go once they are ingested."""
    from gaugeworks.session import shared_dir
    from gaugeworks.sources import store
    spark.createDataFrame([line(6, 50), line(7, 50)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = set(store.listed(spark, f"{shared_dir(spark)}/landing-*"))
    assert [r["row_count"] for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()] == [2]
    assert set(store.listed(spark, f"{shared_dir(spark)}/landing-*")) <= before


def test_texts_are_computed_from_the_table_as_far_as_a_query_reads_them(spark, tmp_path):
    """A query of one text reads the columns that text is made of, and no copy of all texts."""
    spark.createDataFrame([line(6, 50), line(7, 110)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["measure_value"](spark, str(tmp_path))
    assert all("lineitem.parquet" in path for path in rows.inputFiles())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_shipdate" not in plan and "l_discount" not in plan
    assert [r["value"] for r in rows.collect()] == [8.9, 8.9]


def test_rows_of_one_row_group_are_dealt_out_before_they_are_converted(spark, tmp_path, monkeypatch):
    """A file of one row group is one scan task; rows, repeated and null keys stay as they were."""
    lines = [line(1 + i % 28, i, i % 9) for i in range(200)]
    odd = [(None, *lines[3][1:]), lines[5], (None, *lines[3][1:])]
    rows = spark.createDataFrame(lines + odd, LINES)
    rows.coalesce(1).write.parquet(f"{tmp_path}/one/lineitem.parquet")
    rows.repartition(8).write.parquet(f"{tmp_path}/many/lineitem.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/small/lineitem.parquet")
    for name in ("normalize_date", "convert_daily_lenient"):
        monkeypatch.setattr(adapters, "ROWS_PER_TASK", 1_000_000)
        small = QUERIES[name](spark, f"{tmp_path}/small")
        monkeypatch.setattr(adapters, "ROWS_PER_TASK", 10)
        one, many = (QUERIES[name](spark, f"{tmp_path}/{folder}") for folder in ("one", "many"))
        plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" in plan(one) and "l_tax" not in plan(QUERIES["normalize_date"](spark, f"{tmp_path}/one"))
        assert "Exchange" not in plan(many) and "Exchange" not in plan(small)
        assert sorted(map(str, one.collect())) == sorted(map(str, small.collect())) == sorted(map(str, many.collect()))
        assert one.count() == (203 if name == "normalize_date" else 187)


def test_stores_are_built_from_rows_dealt_out(spark, tmp_path, monkeypatch):
    """Tables of one row group make the same stores, from rows of several tasks."""
    lines = spark.createDataFrame([line(1 + i % 28, i % 90, i % 600) for i in range(200)], LINES)
    events = spark.createDataFrame(
        [(i if i % 40 else None, dt.datetime(2024, 5, 1 + i % 20, i % 24), i % 30, "view", 5.0, '{"k": 7}') for i in range(120)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    for folder in ("one", "small"):
        lines.coalesce(1).write.parquet(f"{tmp_path}/{folder}/lineitem.parquet")
        events.coalesce(1).write.parquet(f"{tmp_path}/{folder}/events.parquet")
    told = {}
    for folder, rows in (("one", 10), ("small", 1_000_000)):
        monkeypatch.setattr(adapters, "ROWS_PER_TASK", rows)
        texts = {name: build(spark, f"{tmp_path}/{folder}") for name, build in
                 (("l_orderkey", adapters.daily_texts), ("event_id", adapters.hourly_texts))}
        dealt = [f"hashpartitioning({key}" in t._jdf.queryExecution().executedPlan().toString() for key, t in texts.items()]
        assert dealt == [folder == "one"] * 2
        told[folder] = [sorted(map(str, QUERIES[name](spark, f"{tmp_path}/{folder}").collect()))
                        for name in ("manifest", "chunk_catalog")]
    assert told["one"] == told["small"] and all(told["one"])


def test_daily_bodies_land_as_texts_that_each_scan_parses(spark, tmp_path):
    """Landing neither parses nor judges a body; a scan parses the fields it names, once."""
    spark.createDataFrame([line(6, 50), line(7, 50, 6)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    landed = adapters.daily_bodies(spark, str(tmp_path))
    assert dict(landed.dtypes)["body"] == "string" and "variant" not in landed.columns
    plan = lambda name: QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scan, strict = plan("scan_spatial_zip"), plan("scan_daily_strict")
    assert scan.count("from_json(") == strict.count("from_json(") == 1
    assert "DayWindSpdAvg" in scan and "DayRelHumAvg" not in scan and "RLIKE" not in scan
    assert sorted(r["station_id"] for r in QUERIES["scan_daily_strict"](spark, str(tmp_path)).collect()) == [5, 6]
