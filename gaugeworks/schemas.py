"""Read schemas and fixed values of the station-observation data model."""

from __future__ import annotations

# The record layouts count time from this day.
EPOCH_DATE = "1985-01-01"
EPOCH_YEAR = 1985

# Bytes of one fixed-width record.
RECORD_WIDTH = {"daily": 16, "hourly": 24}

# Validity bounds of a stored record.
MAX_TS = {"daily": 18250, "hourly": 438000}
TEMPERATURE_BOUNDS = (-500, 600)
MAX_HUMIDITY = 100

# Quality-flag bits of a stored record.
QC_BITS = {
    "temperature": 0x01,
    "et": 0x02,
    "wind_speed": 0x04,
    "humidity": 0x08,
    "solar_rad": 0x10,
    "precipitation": 0x20,
    "computed": 0x40,
    "estimated": 0x80,
}

# Fixed-point factor of each measurement.
SCALES = {
    "temp": 10.0,
    "et_daily": 100.0,
    "et_hourly": 1000.0,
    "wind": 10.0,
    "solar": 10.0,
    "wind_dir": 0.5,
    "precip": 100.0,
    "vapor": 100.0,
}

DAILY_MEASURES = (
    "DayAirTmpAvg", "DayAsceEto", "DayWindSpdAvg",
    "DayRelHumAvg", "DaySolRadAvg", "DayPrecip",
)
HOURLY_MEASURES = (
    "HlyAirTmp", "HlyAsceEto", "HlyWindSpd", "HlyWindDir",
    "HlyRelHum", "HlySolRad", "HlyPrecip", "HlyVapPres",
)

MEASURE = "STRUCT<Value: STRING, Qc: STRING, Unit: STRING>"
_MINIMAL = "STRUCT<Value: STRING, Qc: STRING>"


def _fields(names, kind):
    return ", ".join(f"{n}: {kind}" for n in names)


DAILY_IDENTITY = (
    "Date", "Julian", "Station", "Standard", "ZipCodes", "Coordinate", "Address", "Scope",
)
HOURLY_IDENTITY = ("Date", "Hour", "Julian", "Station", "Standard", "ZipCodes", "Scope")


def record_schema(identity, measures) -> str:
    """DDL of a record; the parser skips every field that is not named here."""
    fields = [f"{n}: STRING" for n in identity] + [f"{n}: {MEASURE}" for n in measures]
    return f"STRUCT<{', '.join(fields)}>"


STRICT_RECORD = "STRUCT<Date: STRING, " + _fields(DAILY_MEASURES, _MINIMAL) + ">"

CORRUPT = "_corrupt"


def data_schema(record: str) -> str:
    """DDL of a response's data, whose providers hold ``record`` elements."""
    return (
        "STRUCT<Providers: ARRAY<STRUCT<Name: STRING, Type: STRING, "
        f"Owner: STRING, Records: ARRAY<{record}>>>>"
    )


def response_schema(record: str) -> str:
    """DDL of a response body."""
    return f"Data {data_schema(record)}, {CORRUPT} STRING"


STATION = (
    "STRUCT<StationNbr: STRING, Name: STRING, City: STRING, RegionalOffice: STRING, "
    "County: STRING, ConnectDate: STRING, DisconnectDate: STRING, IsActive: STRING, "
    "IsEtoStation: STRING, Elevation: STRING, GroundCover: STRING, HmsLatitude: STRING, "
    "HmsLongitude: STRING, ZipCodes: ARRAY<STRING>, SitingDesc: STRING>"
)
STATIONS_RESPONSE = f"Stations ARRAY<{STATION}>"
ZIP_INFO = (
    "STRUCT<StationNbr: INT, ZipCode: STRING, ConnectDate: STRING, "
    "DisconnectDate: STRING, IsActive: STRING>"
)
ZIPS_RESPONSE = f"ZipCodes ARRAY<{ZIP_INFO}>"

# One landed line: the request it answers, its landing order, and the body.
LANDED = (
    "request_id STRING, landed_seq BIGINT, station_id INT, "
    "error STRING, body STRING"
)

# The date or time is not stored: it follows from ``ts``.
_OBS_PARTITIONS = "year INT, station_group INT, ingest_id STRING"
STORED = {
    "daily": (
        "station_id INT, ts INT, temperature INT, et INT, "
        "wind_speed INT, humidity INT, solar_radiation INT, qc_flags INT, "
        + _OBS_PARTITIONS
    ),
    "hourly": (
        "station_id INT, ts INT, temperature INT, et INT, "
        "wind_speed INT, wind_direction INT, humidity INT, solar_radiation INT, "
        "precipitation INT, vapor_pressure INT, qc_flags INT, "
        + _OBS_PARTITIONS
    ),
}
DAILY_COLUMNS = (
    "station_id", "year", "ts", "obs_date", "temperature", "et", "wind_speed",
    "humidity", "solar_radiation", "qc_flags",
)
HOURLY_COLUMNS = (
    "station_id", "year", "ts", "obs_ts", "temperature", "et", "wind_speed",
    "wind_direction", "humidity", "solar_radiation", "precipitation",
    "vapor_pressure", "qc_flags",
)
# Name of the derived time column.
TIME_COLUMN = {"daily": "obs_date", "hourly": "obs_ts"}
OBS_COLUMNS = {"daily": DAILY_COLUMNS, "hourly": HOURLY_COLUMNS}

# Partial statistics of a chunk, which merge with those of other chunks.
PARTIALS = "min_temperature INT, max_temperature INT, sum_temperature BIGINT, sum_et BIGINT"
CATALOG = (
    "station_id INT, year INT, row_count BIGINT, min_ts INT, max_ts INT, "
    f"file_count BIGINT, stored_bytes DOUBLE, {PARTIALS}, data_type STRING, ingest_id STRING"
)
CHECKSUM = "decimal(38,0)"
FILES = (
    "station_id INT, year INT, file STRING, file_size BIGINT, row_count BIGINT, "
    f"min_ts INT, max_ts INT, checksum {CHECKSUM}, {PARTIALS}, data_type STRING, ingest_id STRING"
)
# Live files of a snapshot, with the bounds of what they hold.
MANIFEST = (
    "file STRING, file_size BIGINT, ingest_id STRING, year INT, station_group INT, row_count BIGINT, "
    f"checksum {CHECKSUM}, min_station INT, max_station INT, min_ts INT, max_ts INT"
)
