"""Scans and converters over response bodies."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import convert, lookups, quality, ranges
from gaugeworks.schemas import LANDED
from gaugeworks.sources import dimensions, requests, responses as R
from gaugeworks.streaming.ingest import scan_outcomes


def measure(value, qc=" "):
    return {"Value": value, "Qc": qc, "Unit": "(C)"}


def day(date, temp="25.3", et="5.2", wind="3.1", hum="65", sol="2.5", **more):
    return {
        "Date": date, "DayAirTmpAvg": measure(temp), "DayAsceEto": measure(et),
        "DayWindSpdAvg": measure(wind), "DayRelHumAvg": measure(hum), "DaySolRadAvg": measure(sol),
        **more,
    }


def body(*providers, kind="station"):
    return json.dumps({"Data": {"Providers": [
        {"Name": "p", "Type": kind, "Owner": "o", "Records": list(p)} for p in providers]}})


def landed(spark, *bodies, station=2):
    return spark.createDataFrame(
        [(f"r{i}", i, station, None, b) for i, b in enumerate(bodies)], LANDED)


def daily(spark, *bodies):
    return convert.convert_daily(R.scan_daily(landed(spark, *bodies))).orderBy("ts").collect()


def test_good_record(spark):
    [row] = daily(spark, body([day("2024-06-15")]))
    assert row.asDict() | {"obs_date": None} == {
        "station_id": 2, "year": 2024, "ts": 14410, "obs_date": None, "temperature": 253,
        "et": 520, "wind_speed": 31, "humidity": 65, "solar_radiation": 25, "qc_flags": 0}


def test_flags_bad_dates_and_missing_measurements(spark):
    flagged = day("2024-06-15")
    flagged["DayAirTmpAvg"]["Qc"], flagged["DayAsceEto"]["Qc"] = "R", "Y"
    rows = daily(spark, body([flagged, {"Date": "2024-06-16"}, day("invalid-date"), day("2024-02-30")]))
    assert [r["qc_flags"] for r in rows] == [3, 0]
    assert rows[1]["temperature"] == rows[1]["et"] == rows[1]["humidity"] == 0


def test_several_providers_and_empty_ones(spark):
    assert len(daily(spark, body([day("2024-06-15")], [], [day("2024-06-16"), day("2024-06-17")]))) == 3
    assert daily(spark, body()) == []
    assert daily(spark, body([])) == []
    assert daily(spark, '{"Data": {"Prov', '{"Data": {}}', '{"Data": {"Providers": "x"}}') == []


def test_lenient_equals_standard_on_good_dates(spark):
    records = R.scan_daily(landed(spark, body([day("2024-06-15"), day("1985-01-01"), day("2099-12-31")])))
    assert convert.convert_daily(records).exceptAll(convert.convert_daily_lenient(records)).isEmpty()
    records = R.scan_daily(landed(spark, body([day("bad-date"), day("2024-06-15"), day("2101-01-02"), day("2024-02-30")])))
    got = [str(r["obs_date"]) for r in convert.convert_daily_lenient(records).orderBy("ts").collect()]
    assert got == ["2024-03-01", "2024-06-15", "2101-01-02"]


def hour(date, text, qc=" ", **values):
    names = ("HlyAirTmp", "HlyAsceEto", "HlyWindSpd", "HlyWindDir", "HlyRelHum", "HlySolRad", "HlyPrecip", "HlyVapPres")
    record = {"Date": date, "Hour": text}
    for name, value in zip(names, ("23.4", "0.425", "1.5", "181", "55", "901.7", "0.31", "1.27")):
        record[name] = measure(value)
    record["HlyAirTmp"]["Qc"] = qc
    return record


def test_hourly(spark):
    records = R.scan_hourly(landed(spark, body([
        hour("2024-01-15", "14:00"), hour("2024-01-15", "0100"), hour("2024-12-31", "2400"),
        hour("bad-date", "01:00"), hour("2024-01-16", "1", qc="R")])))
    rows = convert.convert_hourly(records).orderBy("ts").collect()
    assert [str(r["obs_ts"]) for r in rows] == [
        "2024-01-15 01:00:00", "2024-01-15 14:00:00", "2024-01-16 00:00:00", "2025-01-01 00:00:00"]
    assert [r["qc_flags"] for r in rows] == [0, 0, 1, 0]
    assert rows[3]["year"] == 2025
    first = rows[0]
    assert (first["temperature"], first["et"], first["wind_direction"], first["solar_radiation"],
            first["precipitation"], first["vapor_pressure"]) == (234, 425, 90, 901, 31, 127)


@pytest.mark.parametrize("text, reason", [
    ('{"Data": {"Providers": [', "malformed body"),
    ('{"Data": {}}', "no providers"),
    ('{"Data": {"Providers": "none"}}', None),
    (body([day("2024-06-15"), day("2024-06-16", temp="n/a")]), "value is not a number"),
    (body([day("2024-06-15", et=" 1")]), "value is not a number"),
    (body([day("2024-06-15", DayPrecip=measure(""))]), "value is not a number"),
    (body([day("2024-06-15", DayPrecip=measure(7))]), "value is not quoted"),
    (body([day("2024-06-15"), day(20240616)]), "value is not quoted"),
])
def test_strict_scan_refuses_whole_responses(spark, text, reason):
    rows = landed(spark, text, body([day("2024-06-17")]))
    assert R.scan_daily_strict(rows).select("Date").collect() == [("2024-06-17",)]
    [reject] = R.strict_rejects(rows).collect()
    assert reject["request_id"] == "r0" and (reason is None or reject["reject"] == reason)


def test_lost_responses_are_listed(spark):
    rows = landed(spark, '{"Data": {"Providers": [', '{"Data": {}}', None, body([day("2024-06-17")]), body([]))
    failed = spark.createDataFrame([("x", 9, 7, "status 502", None)], LANDED)
    got = R.scan_rejects(rows.unionByName(failed)).collect()
    assert sorted(tuple(r) for r in got) == [
        ("r0", 2, "malformed body"), ("r1", 2, "no providers"), ("r2", 2, "no body"), ("x", 7, "status 502")]


def test_a_quote_inside_a_text_is_no_key(spark):
    rows = landed(spark, body([day("2024-06-15", Address='5 "Value": 3 Road')]))
    assert R.scan_daily_strict(rows).count() == 1


def test_strict_converter_drops_the_epoch_day(spark):
    records = convert.minimal(R.scan_daily_strict(landed(
        spark, body([day("1985-01-01"), day("1985-01-02"), day("bad-date"), day("2024-02-30")]))))
    assert convert.convert_daily_minimal(records).count() == 3
    assert [r["ts"] for r in convert.convert_daily_strict(records).orderBy("ts").collect()] == [1, 14304]


def test_batch_outcome_keeps_order_and_repeats(spark):
    good, bad = body([day("2024-06-15"), day("2024-06-16")]), '{"Data": {}}'
    rows = landed(spark, good, station=5).unionByName(landed(spark, bad, station=2)).unionByName(
        spark.createDataFrame([("x", 9, 7, "status 502", None)], LANDED))
    wanted = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 7), (4, 11)], "ordinal int, station_id int")
    outcomes = scan_outcomes(R.strict_records(rows), "station_id")
    got = ranges.in_request_order(lookups.batch_outcome(wanted, outcomes)).collect()
    assert [tuple(r) for r in got] == [
        (0, 5, 2, None), (1, 2, 0, "no providers"), (2, 5, 2, None), (3, 7, 0, "status 502"), (4, 11, 0, None)]


def test_target_scans(spark):
    rows = landed(
        spark,
        body([day("2024-06-15", ZipCodes="93624"), day("2024-06-16", ZipCodes="95974,93624")]),
        body([day("2024-06-17", ZipCodes="95974")], kind="spatial"),
        body([day("2024-06-18", Coordinate="lat=30.25,lng=-111.5", Address="7 Field Lane, Gate 2")]))
    days = lambda frame: sorted(r["Date"] for r in frame.collect())
    assert days(R.scan_daily_by_zip(rows, ["93624"])) == ["2024-06-15", "2024-06-16"]
    assert days(R.scan_spatial_zip(rows, ["95974"])) == ["2024-06-17"]
    assert "DayAirTmpAvg" not in R.scan_geo_zip(rows, ["95974"]).columns
    points = spark.createDataFrame([("lat=30.25,lng=-111.5",)] * 2, "Coordinate string")
    assert days(R.scan_by_coordinate(rows, points)) == ["2024-06-18"]
    places = spark.createDataFrame([("7 Field Lane, Gate 2",)], "Address string")
    assert days(R.scan_by_address(rows, places)) == ["2024-06-18"]


def test_files_with_one_body_each(spark, tmp_path):
    for station, text in ((2, body([day("2024-06-15")])), (5, body([day("2024-06-16"), day("2024-06-17")]))):
        folder = tmp_path / f"station_id={station}"
        folder.mkdir()
        (folder / "2024.json").write_text(json.dumps(json.loads(text), indent=1))
    got = convert.convert_daily(R.scan_daily(R.read_bodies(spark, str(tmp_path))))
    assert sorted((r["station_id"], r["ts"]) for r in got.collect()) == [(2, 14410), (5, 14411), (5, 14412)]


def test_dimensions(spark):
    stations = {"Stations": [{"StationNbr": "2", "Name": "Five", "IsActive": "True", "ZipCodes": ["93624", "93625"]},
                             {"StationNbr": "5", "Name": "Other", "IsActive": "False", "ZipCodes": ["93263"]}]}
    zips = {"ZipCodes": [{"StationNbr": 2, "ZipCode": "93624", "IsActive": "True"}, {"ZipCode": "95974"}]}
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "body string")
    known, mapped = dimensions.scan_stations(frame(stations)), dimensions.scan_zips(frame(zips))
    assert known.count() == 2
    assert [r["Name"] for r in dimensions.scan_station(frame(stations), 2).collect()] == ["Five"]
    assert dimensions.zip_info(frame(zips), "95974").first()["StationNbr"] is None
    assert [tuple(r) for r in lookups.station_zip_join(known, mapped).collect()] == [(2, "93624", "Five", "True")]


def test_request_plan(spark):
    targets = spark.createDataFrame([
        ("station_data", "2", "2024-01-01", "12/31/2024", False, ""),
        ("geo_zip_data", "93624,95974", "2024-01-01", "2024-01-31", False, "SCS"),
        ("spatial_address_data", "addr-name=a b,addr=~*", "2024-01-01", "2024-01-31", False, ""),
        ("station", "117", "2024-01-01", "2024-01-31", True, "SCS"),
        ("spatial_zip", "95974", None, None, None, None),
        ("station_zips", None, None, None, None, None),
    ], "endpoint string, target string, start_date string, end_date string, hourly boolean, prefer string")
    got = {r["endpoint"]: r["url"] for r in requests.data_plan(targets, "https://example.test/base/").collect()}
    items = requests.DAILY_ITEMS.replace(",", "%2C")
    assert got["station_data"] == (
        "https://example.test/base/StationWeb/GetDataByStationNumber?dataItems=" + items
        + "&endDate=2024-12-31&isHourly=false&startDate=2024-01-01&stationNbrs=2&unitOfMeasure=M")
    assert "&prefer=SCS&" in got["geo_zip_data"] and "zipCodes=93624%2C95974" in got["geo_zip_data"]
    assert "addresses=addr-name%3Da+b%2Caddr%3D~%2A&" in got["spatial_address_data"]
    assert got["station"].endswith("/StationWeb/GetStationByStationNumber?stationNbr=117")
    assert got["spatial_zip"].endswith("/SpatialWeb/GetSpatialZipCodeInfoByZipCode?zipCode=95974")
    assert got["station_zips"].endswith("/StationWeb/GetAllStationsZipCodes")
    assert "isHourly" not in got["spatial_address_data"]


@pytest.mark.parametrize("kind, last", [("daily", 18250), ("hourly", 438000)])
def test_validity_edges(spark, kind, last):
    rows = [(0, 1, 0, 0), (1, last, -500, 100), (1, last + 1, 0, 0), (1, 1, -501, 0), (1, 1, 600, 0), (1, 1, 601, 0), (1, 1, 0, 101)]
    frame = spark.createDataFrame(rows, "station_id int, ts int, temperature int, humidity int")
    assert sorted(tuple(r) for r in quality.valid(frame, kind).collect()) == [(1, 1, 600, 0), (1, last, -500, 100)]
    assert quality.invalid(frame, kind).count() == 5


def odd_bodies():
    """Bodies that scans refuse or read in part, one for each way."""
    good = body([day("2024-06-15"), day("2024-06-16", temp="7")])
    twice = json.loads(good)
    twice["Data"]["Providers"] = twice["Data"]["Providers"] * 2
    unquoted = good.replace('"Value": "7"', '"Value": 7').replace('"Value":"7"', '"Value":7')
    assert unquoted != good
    return [good, json.dumps(twice), None, "", "{", "[]", "{}", '{"Data": {}}', '{"Data": null}',
            '{"Data": {"Providers": []}}', '{"Data": {"Providers": null}}', '{"Data": {"Providers": [{"Name": "x"}]}}',
            '{"Data": {"Providers": [{"Records": null}]}}', '{"Data": {"Providers": [{"Records": []}]}}',
            unquoted, body([day("2024-06-15", temp="x7")]), body([day("2024-06-15", temp=" 7")]), good[:-3]]


def test_parsed_bodies_scan_like_texts(spark):
    rows = [(f"r{i}", i, i % 3, None, text) for i, text in enumerate(odd_bodies())]
    rows.append(("failed", 99, 5, "status 502", None))
    texts = spark.createDataFrame(rows, "request_id string, landed_seq bigint, station_id int, error string, body string")
    variants = R.parsed(texts)
    assert "body" not in variants.columns
    plain = lambda frame: sorted((str(r.asDict(recursive=True)) for r in frame.collect()))
    for scan in (lambda f: R.scan_daily(f, "request_id"), lambda f: R.scan_daily_strict(f, "request_id"),
                 lambda f: R.strict_records(f, "request_id", "landed_seq"), R.strict_rejects, R.scan_rejects):
        one, other = scan(texts), scan(variants)
        assert one.schema.simpleString() == other.schema.simpleString()
        assert plain(one) == plain(other)


def test_variants_are_extracted_by_the_scan(spark, tmp_path):
    texts = spark.createDataFrame([("a", 1, 2, None, body([day("2024-06-15")]))],
                                  "request_id string, landed_seq bigint, station_id int, error string, body string")
    R.parsed(texts).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    for frame in (R.scan_daily(stored), R.scan_daily_strict(stored)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in plan and "parse_json" not in plan and "try_variant_get" not in plan
        assert frame.count() == 1


def test_unquoted_fields_are_found_wherever_they_stand(spark):
    """Three patterns that begin with a fixed text tell what one for all fields told."""
    heads = ['"Date"', '"Value"', '"Qc"', 'Date"', '\\"Value\\"', '"Unit"', '"ValueQc"', '"Value" "Qc"']
    tails = [":5", " : -1", ":\n[", ":{", ":true", ":false", ":null", ':"5"', ": ", "", ":x"]
    texts = [before + head + tail for before in ("", "{", '"Date":"') for head in heads for tail in tails]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "body string")
    told = rows.select(
        F.col("body").rlike(r'"(Date|Value|Qc)"\s*:\s*[-0-9tf{\[]').alias("one"), R._is_unquoted(F.col("body")).alias("three"))
    got = {(r["one"], r["three"]) for r in told.collect()}
    assert got == {(True, True), (False, False), (None, None)}
    plan = told.select("three")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") == 3 and "(Date|Value|Qc)" not in plan
