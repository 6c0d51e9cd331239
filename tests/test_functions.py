"""Value tables of the scalar rules."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import dates, measures, texts
from gaugeworks.operators import ranges


def rows(spark, values, expression, schema="x string"):
    """``expression`` over column ``x`` for all values, in order."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["out"] for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


@pytest.fixture(autouse=True)
def the_column(spark):
    globals()["X"] = F.col("x")


def test_parse_date(spark):
    got = rows(spark, [
        "2024-01-15", "2023-12-31", "2024-02-29", "01/15/2024", "", "not-a-date", None,
        "2024-02-30", "2024-1-15", "2024-01-15 ", " 2024-01-15", "2024-01-1T", "2024-01-1 ", "2024-01-15\n",
    ], dates.parse_date(X))
    assert got == [
        dt.date(2024, 1, 15), dt.date(2023, 12, 31), dt.date(2024, 2, 29), dt.date(2024, 1, 15),
    ] + [None] * 10


def test_normalize_date(spark):
    assert rows(spark, ["2024-06-15", "06/15/2024", "bad-date"], dates.normalize_date(X)) == [
        "2024-06-15", "2024-06-15", "bad-date"]


def test_lenient_parts(spark):
    # Each part at its bounds and one beyond them; then other marks, and a sign less or more.
    whole, bounds = (2037, 8, 17), ((1985, 2100), (1, 12), (1, 31))
    text = lambda parts, mark="-": mark.join(f"{p:0{4 if i == 0 else 2}d}" for i, p in enumerate(parts))
    put = lambda place, value: tuple(value if i == place else p for i, p in enumerate(whole))
    taken = [put(i, v) for i, ends in enumerate(bounds) for v in ends] + [whole]
    refused = [text(put(i, v)) for i, (low, high) in enumerate(bounds) for v in (low - 1, high + 1)]
    refused += [text(whole, mark) for mark in ("/", ".", " ", "")] + [text(whole)[:n] for n in range(10)] + [
        text(whole) + "0", "x" + text(whole)]
    got = [tuple(p) if p else None for p in rows(spark, [*map(text, taken), *refused], dates.lenient_parts(X))]
    assert got == taken + [None] * len(refused)


def test_lenient_date_rolls_over_and_falls_back(spark):
    got = rows(spark, ["2024-02-30", "2023-02-31", "2024-04-31", "2101-01-02", "2101-02-30", "bad-date", "1984-12-31"],
               dates.lenient_date(X))
    assert got == [dt.date(2024, 3, 1), dt.date(2023, 3, 3), dt.date(2024, 5, 1),
                   dt.date(2101, 1, 2), None, None, dt.date(1984, 12, 31)]


def test_epoch_counts(spark):
    days = ["1985-01-01", "1985-01-02", "2024-01-15", "2034-12-20"]
    assert rows(spark, days, dates.days_since_epoch(X.cast("date"))) == [0, 1, 14258, 18250]
    assert rows(spark, [0, 1, 14258, 18250], dates.days_to_date(X), "x int") == [
        dt.date.fromisoformat(d) for d in days]
    assert rows(spark, [0, 342193], dates.hours_to_timestamp(X), "x int") == [
        dt.datetime(1985, 1, 1), dt.datetime(2024, 1, 15, 1)]
    months = rows(spark, [f"2020-{m:02d}-15" for m in range(1, 13)], dates.days_since_epoch(X.cast("date")))
    assert months == sorted(set(months))
    assert dates.ts_of("2024-01-15", "daily") == 14258
    assert dates.ts_of("2024-01-15", "hourly") == 14258 * 24


def test_month_length(spark):
    months = [(2024, 2), (2023, 2), (1900, 2), (2000, 2), (2024, 4), (2024, 12)]
    frame = spark.createDataFrame([(i, y, m) for i, (y, m) in enumerate(months)], "i int, y int, m int")
    got = frame.select("i", dates.month_length(F.col("y"), F.col("m")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [29, 28, 28, 29, 30, 31]


def test_parse_hour(spark):
    got = rows(spark, ["14:00", "0100", "2400", "1", "ab:00", "", None, "+5", "-3:00", "7x"], dates.parse_hour(X))
    assert got == [14, 1, 24, 0, 0, 0, 0, 5, -3, 0]


def test_measure_value(spark):
    m = F.when(X.isNotNull(), F.struct(X.alias("Value"), F.lit("").alias("Qc")))
    texts_ = [None, "23.5", "0", "-5.2", "", "abc", " ", " 5", "5 ", "1.0d", "1e999", "+.5", "1e1", "5.", "NaN", "1\n"]
    assert rows(spark, texts_, measures.measure_value(m)) == [
        0, 23.5, 0, -5.2, 0, 0, 0, 0, 0, 0, 0, 0.5, 10, 5, 0, 0]


def test_plain_numbers_are_told_without_a_pattern(spark):
    """The ends of a text tell what the pattern told, for all that the cast takes beyond it."""
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    rng = random.Random(6)
    odd = ["0x1p3", "0X1P-2", "-0x1.8p1", "1f", "1D", "Infinity", "+inf", "-Infinity", "nan", "\x001", "1\x00", "\t1", "1\t",
           "+", "-", ".", "e1", "1e", "1e+", "--1", "1.2.3", "1,5", "\u0661", "1\u0661", "\u00a01", "1 2", "1e-400", None]
    odd += ["".join(rng.choice("0123456789..+-eExXfd \n") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    told = [float(t) if t is not None and re.fullmatch(pattern, t) else 0.0 for t in odd]
    assert rows(spark, odd, measures.parse_number(X)) == told and sum(t != 0 for t in told) > 300
    number = spark.createDataFrame([("1",)], "x string").select(measures.parse_number(X))
    assert "RLIKE" not in number._jdf.queryExecution().executedPlan().toString()


def test_strict_number(spark):
    texts_ = ["1", "-1.5", "1e3", "-.5", "+1", ".5", "", " 1", "abc", "1e999", "-"]
    assert rows(spark, texts_, measures.is_strict_number(X)) == [
        True, True, True, True, False, False, False, False, False, False, False]


def test_qc_flag(spark):
    m = F.when(X != "none", F.struct(F.lit("1").alias("Value"), X.alias("Qc")))
    assert rows(spark, ["none", " ", "", "R", "Y", "X"], measures.qc_flagged(m)) == [
        False, False, False, True, True, True]


def test_scale_truncates_in_32_bits(spark):
    values = [4.35, -5.29, 25.38, 0.0, 1e30]
    assert rows(spark, values, measures.scale(X, "et_daily"), "x double") == [435, -529, 2538, 0, 0]
    assert rows(spark, [-5.29, 25.38], measures.scale(X, "temp"), "x double") == [-52, 253]
    assert rows(spark, [359.0], measures.scale(X, "wind_dir"), "x double") == [179]
    assert rows(spark, [179], measures.unscale(X, "wind_dir"), "x int") == [358.0]


def test_qc_names(spark):
    assert rows(spark, [0, 1, 2, 3, 255], measures.qc_names(X), "x int") == [
        [], ["temperature"], ["et"], ["temperature", "et"], list(measures.QC_BITS)]


def test_format_measure(spark):
    got = rows(spark, [23.456, None, -1.0], measures.format_measure(X, F.lit("R")), "x double")
    assert [tuple(g) if g else None for g in got] == [("23.46", "R", ""), None, ("-1.00", "R", "")]


def test_station_list(spark):
    # Lists from a small grammar: numbers and ranges, with blanks and signs, joined by commas.
    rng = random.Random(6)
    blank = lambda: " " * rng.randrange(3)

    def part():
        low, long = rng.randrange(300), rng.randrange(-2, 5)
        if rng.random() < 0.5:
            return blank() + "+" * (rng.random() < 0.2) + str(low) + blank(), [low]
        high = max(0, low + long)
        return f"{blank()}{low}{blank()}-{blank()}{high}{blank()}", list(range(low, high + 1))

    lists = [[part() for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    assert rows(spark, [",".join(t for t, _ in parts) for parts in lists], texts.station_list(X)) == [
        [i for _, ids in parts for i in ids] for parts in lists]
    # One part that is none spoils a list, wherever it stands.
    number = lambda: str(rng.randrange(300))
    spoilt = [blank(), "-", f"{number()}-", f"-{number()}", "-".join(number() for _ in range(3)),
              f"{number()}.{number()}", f"{number()} {number()}", f"{number()}{chr(rng.randrange(97, 123))}"]
    lists = []
    for bad in spoilt:
        parts = [part()[0] for _ in range(2)]
        lists += [",".join(parts[:k] + [bad] + parts[k:]) for k in range(3)] + [bad]
    assert rows(spark, lists, texts.station_list(X)) == [None] * len(lists)


@pytest.mark.parametrize("ids", [[], [9], [40, 7], [7, 40, 7, 8], list(range(20, 0, -1))])
def test_sorted_ids(spark, ids):
    assert rows(spark, [ids], texts.sorted_ids(X), "x array<bigint>") == [sorted(ids)]


def test_long_ranges_are_cut_in_steps(spark):
    lists = [("4, 8-10",), ("9-7",), ("3-x",), ("1000001-4000000",), (f"{10 ** 17}-{10 ** 17 + 2}",)]
    got = ranges.expand_stations(spark.createDataFrame(lists, "l string"), "l")
    found = {r["l"]: tuple(r)[1:] for r in got.groupBy("l", "ok").agg(
        F.count("station_id"), F.min("station_id"), F.max("station_id")).collect()}
    assert found == {
        "4, 8-10": (True, 4, 4, 10), "9-7": (True, 0, None, None), "3-x": (False, 0, None, None),
        "1000001-4000000": (True, 3_000_000, 1000001, 4000000),
        f"{10 ** 17}-{10 ** 17 + 2}": (True, 3, 10 ** 17, 10 ** 17 + 2)}


def test_target_texts(spark):
    places = [[("north", "field 3, gate"), ("south", "")], []]
    assert rows(spark, places, texts.addresses_text(X), "x array<struct<name:string,address:string>>") == [
        "addr-name=north,addr=field 3, gate;addr-name=south,addr=", ""]


def test_coordinates_are_plain_decimals(spark):
    """Digits and a point alone, which read back as the same number."""
    rng = random.Random(7)
    known = [0.0, -0.0005, 0.001, 1e-7, 5e-10, 12345678.5, -1e7, 9999999.0, 1e19, 1e20, 123456789e20, 7.0, -0.25, 50.0]
    numbers = known + [rng.uniform(-180, 180) for _ in range(50)] + [rng.choice((-1, 1)) * 10 ** rng.uniform(-12, 25)
                                                               for _ in range(100)]
    points = [[(a, b)] for a, b in zip(numbers, reversed(numbers))]
    got = rows(spark, points, texts.coordinates_text(X), "x array<struct<lat:double,lng:double>>")
    parts = [re.fullmatch(r"lat=(-?\d+(?:\.\d*[1-9])?),lng=(-?\d+(?:\.\d*[1-9])?)", text).groups() for text in got]
    assert [(float(a), float(b)) for a, b in parts] == [p for (p,) in points]
    assert [a for a, _ in parts[:len(known)]] == [format(Decimal(repr(x)).normalize(), "f") for x in known]
    several = [[(1.5, 2.0), (-3.25, 0.0005)]]
    assert rows(spark, several, texts.coordinates_text(X), "x array<struct<lat:double,lng:double>>") == [
        "lat=1.5,lng=2;lat=-3.25,lng=0.0005"]


def test_retry_class(spark):
    cases = [
        ("refused by the gate", 418, False), ("slow down", 429, True), ("upstream fell over", 504, True),
        (None, 500, None), (None, 0, None), ("no status and no known text", 0, False),
        *((f"while reading: {marker} (attempt 2)", 0, True) for marker in texts.RETRYABLE_TEXTS),
        *((marker.swapcase(), 0, False) for marker in texts.RETRYABLE_TEXTS),
    ]
    frame = spark.createDataFrame([(i, e, s) for i, (e, s, _) in enumerate(cases)], "i int, e string, s int")
    got = frame.select("i", texts.should_retry(F.col("e"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [r for _, _, r in cases]


def test_status_hint_and_backoff(spark):
    hints = rows(spark, [200, 400, 401, 403, 429, 500, 503], texts.status_hint(X), "x int")
    assert hints == [None, None, "credentials", "credentials", "slow_down", "later", "later"]
    assert rows(spark, [0, 1, 2, 3], texts.backoff_seconds(X), "x int") == [0, 2, 4, 8]
