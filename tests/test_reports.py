"""Aggregates over logs and the registered queries as a whole."""

import json

import pytest

from gaugeworks.operators import reports, stats
from gaugeworks.plans import ORACLES, QUERIES, adapters
from gaugeworks.sources import responses

LOG = (
    "ordinal int, station_id int, year int, success boolean, records int, attempts int, "
    "status_code int, error string, "
    + ", ".join(f"{p} double" for p in stats.PHASES) + ", bytes_transferred bigint"
)


def log(spark, *rows):
    phases = [1.0] * len(stats.PHASES)
    return spark.createDataFrame(
        [(i, s, 2024, e is None, n, 1, 200 if e is None else 502, e, *phases, 99) for i, (s, n, e) in enumerate(rows)], LOG)


def test_fetch_summary(spark):
    rows = log(spark, (2, 10, None), (5, 0, "bad gateway"))
    assert tuple(stats.fetch_summary(rows).first()) == (2, 1, 1, 10)
    assert tuple(stats.fetch_summary(log(spark, (1, 1, None)).where("false")).first()) == (0, 0, 0, 0)
    lines = [json.loads(r["json"]) for r in reports.fetch_summary_json(rows).orderBy("line").collect()]
    assert lines[0] == {"total_stations": 2, "successful": 1, "failed": 1, "total_records": 10}
    assert "error" not in lines[1] and lines[2]["error"] == "bad gateway"
    timing = stats.fetch_timing(rows).orderBy("ordinal").collect()
    assert timing[0]["total_ms"] == 1.0 and timing[1]["total_ms"] is None and timing[1]["error"] == "bad gateway"


def test_ops_report(spark):
    schema = "kind string, duration_ms double, ratio double"
    rows = [("query", 2.0, None), ("query", 4.0, None), ("compression", None, 2.0), ("compression", None, 4.0)]
    assert tuple(stats.ops_report(spark.createDataFrame(rows, schema)).first()) == (2, 3.0, 0, 0.0, 2, 3.0)
    assert tuple(stats.ops_report(spark.createDataFrame([], schema)).first()) == (0, 0.0, 0, 0.0, 0, 0.0)


def test_query_throughput(spark):
    schema = "read_ms double, filter_ms double, records int"
    got = stats.query_throughput(spark.createDataFrame([(400.0, 100.0, 366), (400.0, 100.0, 366)], schema)).first()
    assert tuple(got) == (2, 732, 400.0, 200.0 / 732, 732.0)
    assert tuple(stats.query_throughput(spark.createDataFrame([], schema)).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_storage_efficiency(spark):
    catalog = spark.createDataFrame(
        [(2, 2024, "daily", 250, 1000.0), (2, 2024, "hourly", 250, 1000.0)],
        "station_id int, year int, data_type string, row_count bigint, stored_bytes double")
    daily, hourly = stats.storage_efficiency(catalog).orderBy("data_type").collect()
    assert (daily["raw_bytes"], daily["ratio"], daily["bytes_per_record"], daily["saving_pct"]) == (4000, 4.0, 4.0, 75.0)
    assert (hourly["raw_bytes"], hourly["ratio"]) == (6000, 6.0)


def test_schedule(spark):
    got = reports.retry_schedule(log(spark, (2, 1, None)), 3).orderBy("attempt").collect()
    assert [(r["attempt"], r["wait_s"], r["max_jitter_s"]) for r in got] == [(0, 0, 0.0), (1, 2, 1.0), (2, 4, 2.0), (3, 8, 4.0)]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["convert_daily", "daily_stats", "scan_daily_strict", "stored_range", "qc_runs"])
def test_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


def test_a_body_is_parsed_once(spark):
    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    # Scans over texts parse each once; registered scans read bodies parsed when they landed.
    texts = responses.scan_daily(adapters.build_daily_landed(spark, sf).repartition(2))
    assert plan_of(texts).count("from_json(") == 1
    registered = plan_of(QUERIES["scan_daily"](spark, sf))
    assert "from_json" not in registered and "parse_json" not in registered


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
