"""Building blocks of the checking SQL."""

from __future__ import annotations

from gaugeworks.plans import adapters

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number(text: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_full_match({text}, '{_NUMBER}') "
        f"THEN try_cast({text} AS DOUBLE) END, 0.0::DOUBLE)"
    )


def fixed(value: str, factor: str) -> str:
    """32-bit multiply, then truncate."""
    return f"cast(trunc(cast({value} AS FLOAT) * cast({factor} AS FLOAT)) AS INTEGER)"


def whole(value: str) -> str:
    return f"cast(trunc({value}) AS INTEGER)"


def flagged(value: str, qc: str) -> str:
    return f"({value} IS NOT NULL AND coalesce({qc}, '') NOT IN ('', ' '))"


def iso_date(text: str) -> str:
    return rf"CASE WHEN regexp_full_match({text}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast({text} AS DATE) END"


def us_date(text: str) -> str:
    iso = f"concat(substr({text}, 7, 4), '-', substr({text}, 1, 2), '-', substr({text}, 4, 2))"
    return rf"CASE WHEN regexp_full_match({text}, '\d{{2}}/\d{{2}}/\d{{4}}') THEN try_cast({iso} AS DATE) END"


def lenient_date(text: str) -> str:
    """Day 1-31 passes in any month of 1985-2100, else the strict rule."""
    y, m, d = (f"try_cast(substr({text}, {a}, {n}) AS INTEGER)" for a, n in ((1, 4), (6, 2), (9, 2)))
    shaped = rf"regexp_full_match({text}, '\d{{4}}-\d{{2}}-\d{{2}}')"
    ok = f"{shaped} AND {y} BETWEEN 1985 AND 2100 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
    rolled = f"try_cast(concat(substr({text}, 1, 7), '-01') AS DATE) + ({d} - 1)"
    return f"CASE WHEN {ok} THEN cast({rolled} AS DATE) ELSE {iso_date(text)} END"


def hour(text: str) -> str:
    head = f"substr({text}, 1, 2)"
    return (
        rf"coalesce(CASE WHEN regexp_full_match({head}, '\d{{2}}|[+-]\d') "
        f"THEN try_cast({head} AS INTEGER) END, 0)"
    )


EPOCH = "DATE '1985-01-01'"

# One value that is no number refuses every record of its page.
RAW_DAILY = f"""raw AS (SELECT *,
  CASE WHEN fault = 'failed' THEN 'status 502' WHEN fault = 'truncated' THEN 'malformed body'
    WHEN fault = 'no providers' THEN 'no providers'
    WHEN bool_or(tmp_v IN ('', 'abc', ' 5')) OVER (PARTITION BY page) THEN 'value is not a number'
    END AS reject FROM (SELECT {adapters.DAILY} FROM lineitem))"""
RAW_HOURLY = f"raw AS (SELECT {adapters.HOURLY} FROM events)"


def daily(rule=iso_date, extra: str = "", where: str = "true") -> str:
    """``WITH`` list ending in ``obs``: converted daily rows."""
    return f"""WITH {RAW_DAILY},
dated AS (SELECT *, {rule('day_text')} AS obs_date FROM raw WHERE {where}),
obs AS (SELECT {extra} station_id, src_order, src_line, src_part,
  cast(year(obs_date) AS INTEGER) AS year,
  cast(obs_date - {EPOCH} AS INTEGER) AS ts, obs_date,
  {fixed(number('tmp_v'), '10')} AS temperature,
  {fixed(number('eto_v'), '100')} AS et,
  {fixed(number('wnd_v'), '10')} AS wind_speed,
  {whole(number('hum_v'))} AS humidity,
  {whole(number('sol_v') + ' * 10')} AS solar_radiation,
  cast((CASE WHEN {flagged('tmp_v', 'tmp_q')} THEN 1 ELSE 0 END)
    + (CASE WHEN {flagged('eto_v', 'eto_q')} THEN 2 ELSE 0 END) AS INTEGER) AS qc_flags
  FROM dated WHERE obs_date >= {EPOCH})
"""


def hourly(rule=iso_date) -> str:
    """``WITH`` list ending in ``obs``: converted hourly rows."""
    return f"""WITH {RAW_HOURLY},
dated AS (SELECT *, {rule('day_text')} AS obs_date FROM raw),
timed AS (SELECT *, cast((obs_date - {EPOCH}) * 24 + {hour('hour_text')} AS INTEGER) AS ts
  FROM dated),
obs AS (SELECT station_id, src_event,
  cast(year(TIMESTAMP '1985-01-01' + to_hours(ts)) AS INTEGER) AS year, ts,
  TIMESTAMP '1985-01-01' + to_hours(ts) AS obs_ts,
  {fixed(number('tmp_v'), '10')} AS temperature,
  {fixed(number('eto_v'), '1000')} AS et,
  {fixed(number('wnd_v'), '10')} AS wind_speed,
  {whole(number('dir_v') + ' / 2')} AS wind_direction,
  {whole(number('hum_v'))} AS humidity,
  {whole(number('sol_v'))} AS solar_radiation,
  {fixed(number('pre_v'), '100')} AS precipitation,
  {fixed(number('vap_v'), '100')} AS vapor_pressure,
  cast(CASE WHEN {flagged('tmp_v', 'tmp_q')} THEN 1 ELSE 0 END AS INTEGER) AS qc_flags
  FROM timed WHERE ts >= 0)
"""


VALID_DAILY = "(station_id <> 0 AND ts <= 18250 AND temperature BETWEEN -500 AND 600 AND humidity <= 100)"
VALID_HOURLY = "(station_id <> 0 AND ts <= 438000 AND temperature BETWEEN -500 AND 600 AND humidity <= 100)"
DAILY_COLUMNS = (
    "station_id, year, ts, obs_date, temperature, et, wind_speed, humidity, "
    "solar_radiation, qc_flags"
)
HOURLY_COLUMNS = (
    "station_id, year, ts, obs_ts, temperature, et, wind_speed, wind_direction, "
    "humidity, solar_radiation, precipitation, vapor_pressure, qc_flags"
)
