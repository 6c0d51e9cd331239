"""Ordered computations along a station's readings."""

from __future__ import annotations

from gaugeworks.operators import series
from gaugeworks.plans import adapters as A, checks as C
from gaugeworks.plans.projections import daily_obs
from gaugeworks.plans.registry import query

VALUES = ("temperature", "et", "wind_speed", "humidity", "solar_radiation")
# Equal rows may tie; nothing else does.
ORDER = ("ts", *A.DAILY_KEYS, *VALUES, "qc_flags")
_OVER = f"(PARTITION BY station_id ORDER BY {', '.join(ORDER)})"
_KEYS = ("station_id", "ts", *A.DAILY_KEYS)


def deltas(spark, sf, **options):
    return series.delta_columns(daily_obs(spark, sf), list(VALUES), list(ORDER), **options)


@query("delta_columns", f"""{C.daily()} SELECT {', '.join(_KEYS)}, {', '.join(
    f"{v} - coalesce(lag({v}) OVER {_OVER}, 0) AS d_{v}" for v in VALUES)} FROM obs""")
def delta_columns(spark, sf):
    return deltas(spark, sf).select(*_KEYS, *(f"d_{v}" for v in VALUES))


@query("undo_delta", f"{C.daily()} SELECT {', '.join(_KEYS)}, {', '.join(VALUES)} FROM obs")
def undo_delta(spark, sf):
    rebuilt = series.undo_delta(deltas(spark, sf), list(VALUES), list(ORDER))
    return rebuilt.selectExpr(*_KEYS, *(f"cast({v} AS int) AS {v}" for v in VALUES))


@query("qc_runs", f"""{C.daily()},
marked AS (SELECT *, CASE WHEN qc_flags = lag(qc_flags) OVER {_OVER} THEN 0 ELSE 1 END AS starts FROM obs),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY station_id ORDER BY {', '.join(ORDER)}
  ROWS UNBOUNDED PRECEDING) AS run_no FROM marked)
SELECT station_id, cast(run_no AS BIGINT) AS run_no, max(qc_flags) AS value, count(*) AS run_length
FROM numbered GROUP BY station_id, run_no""")
def qc_runs(spark, sf):
    return series.value_runs(daily_obs(spark, sf), "qc_flags", list(ORDER))
