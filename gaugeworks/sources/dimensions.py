"""Station and zip dimensions from their landed response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.schemas import STATIONS_RESPONSE, ZIPS_RESPONSE


def scan_stations(landed: DataFrame) -> DataFrame:
    response = F.from_json("body", STATIONS_RESPONSE)
    return landed.select(response.alias("_r")).select(F.inline("_r.Stations"))


def scan_station(landed: DataFrame, station: int) -> DataFrame:
    return scan_stations(landed).where(F.col("StationNbr") == str(station))


def scan_zips(landed: DataFrame) -> DataFrame:
    """Zip map rows; the spatial map has no station number."""
    response = F.from_json("body", ZIPS_RESPONSE)
    return landed.select(response.alias("_r")).select(F.inline("_r.ZipCodes"))


def zip_info(landed: DataFrame, zip_code: str) -> DataFrame:
    return scan_zips(landed).where(F.col("ZipCode") == zip_code)
