"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  Landing and
storing the input happens before the clock starts, as it does for a query in
use; every query runs once to warm up and counts with the median of the runs
after that.  The result of each is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gaugeworks.operators import quality
from gaugeworks.plans import QUERIES, adapters, sinks
from gaugeworks.schemas import RECORD_WIDTH
from gaugeworks.session import build_session, scratch
from gaugeworks.sources import snapshots, store

HEADLINE = (
    "scan_daily", "scan_hourly", "scan_daily_strict", "scan_batch",
    "convert_daily", "convert_daily_lenient", "convert_hourly",
    "valid_daily", "daily_stats", "store_stats", "fetch_summary", "ops_report",
    "pending_chunks", "catalog_semi", "query_daily_range", "query_preview",
    "delta_columns", "qc_runs", "pack_daily", "unpack_daily",
    "write_obs", "stored_daily", "stored_range", "chunk_catalog", "readback_diff", "verify_files",
)
RUNS = 3


def _drain(frame):
    frame.write.format("noop").mode("overwrite").save()


def _median(run):
    run()
    spent = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        spent.append(time.perf_counter() - start)
    return statistics.median(spent)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", app="bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    for landed in (adapters.daily_landed, adapters.hourly_landed, adapters.stations_landed):
        landed(spark, folder)
    root = sinks.stored_root(spark, folder)
    sinks.many_root(spark, folder)

    seconds = {
        name: round(_median(lambda: _drain(QUERIES[name](spark, folder))), 4) for name in HEADLINE
    }

    # Throughput of the store itself, on rows that are already converted.
    throughput = {}
    for kind in ("daily", "hourly"):
        rows = snapshots.read_obs(spark, root, kind).count()
        read = _median(lambda: _drain(snapshots.read_obs(spark, root, kind)))
        write = _median(lambda: store.write_obs(
            quality.valid(snapshots.read_obs(spark, root, kind), kind), scratch(spark, "bench"), kind, "a"))
        stored = store.size_of(spark, f"{root}/data_type={kind}")
        throughput[kind] = {
            "rows": rows,
            "read_rows_per_sec": round(rows / read),
            "write_rows_per_sec": round(rows / write),
            "bytes_per_row": round(stored / rows, 2),
            "compression_ratio": round(rows * RECORD_WIDTH[kind] / stored, 2),
        }
    raw = adapters.table(spark, folder, "lineitem").count()
    throughput["convert_rows_per_sec"] = round(raw / seconds["convert_daily"])
    throughput["scan_rows_per_sec"] = round(raw / seconds["scan_daily"])

    print(json.dumps({
        "metric": "sum of median seconds per headline query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "store": throughput,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
