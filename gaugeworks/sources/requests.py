"""Request plans: one row per request the landing job has to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.functions.dates import normalize_date

# Request paths of the public web API.
PATHS = {
    "station_data": "/StationWeb/GetDataByStationNumber",
    "station_zip_data": "/StationWeb/GetDataByStationZipCodes",
    "spatial_coordinate_data": "/SpatialWeb/GetDataBySpatialCoordinates",
    "spatial_address_data": "/SpatialWeb/GetDataByAddresses",
    "spatial_zip_data": "/SpatialWeb/GetDataBySpatialZipCodes",
    "geo_zip_data": "/GeoStationWeb/GetDataByGeoStationZipCodes",
    "stations": "/StationWeb/GetAllStations",
    "station": "/StationWeb/GetStationByStationNumber",
    "station_zips": "/StationWeb/GetAllStationsZipCodes",
    "station_zip": "/StationWeb/GetStationZipCodeInfoByZipCode",
    "spatial_zips": "/SpatialWeb/GetAllSpatialZipCodes",
    "spatial_zip": "/SpatialWeb/GetSpatialZipCodeInfoByZipCode",
}

# Measurement sets a request may name.
DAILY_ITEMS = (
    "day-air-tmp-avg,day-asce-eto,day-wind-spd-avg,day-rel-hum-avg,day-sol-rad-avg,day-precip"
)
HOURLY_ITEMS = (
    "hly-air-tmp,hly-asce-eto,hly-wind-spd,hly-wind-dir,hly-rel-hum,hly-sol-rad,"
    "hly-precip,hly-vap-pres"
)
SPATIAL_POINT_ITEMS = "day-asce-eto,day-sol-rad-avg"
SPATIAL_ZIP_ITEMS = "day-asce-eto,day-sol-rad-avg,day-wind-spd-avg"


def measure_list(endpoint: Column, hourly: Column | None = None) -> Column:
    """Measurement set that goes with an endpoint name of ``PATHS``."""
    hourly = F.lit(False) if hourly is None else hourly
    return (
        F.when(endpoint.isin("spatial_zip_data", "geo_zip_data"), SPATIAL_ZIP_ITEMS)
        .when(endpoint.isin("spatial_coordinate_data", "spatial_address_data"), SPATIAL_POINT_ITEMS)
        .when(endpoint.isin("station_data", "station_zip_data") & hourly, HOURLY_ITEMS)
        .when(endpoint.isin("station_data", "station_zip_data"), DAILY_ITEMS)
    )


def path_of(endpoint: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in PATHS.items() for x in pair))[endpoint]


def escape(text: Column) -> Column:
    """Query escaping that keeps ``~`` and escapes ``*``."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_text(params: dict[str, Column]) -> Column:
    """``key=value`` pairs in key order; a null value leaves its pair out."""
    pairs = (F.concat(F.lit(f"{k}="), escape(params[k])) for k in sorted(params))
    return F.concat_ws("&", *pairs)


def data_plan(targets: DataFrame, base_url: str) -> DataFrame:
    """Add ``path``, ``items``, ``query`` and ``url`` to a table of requests.

    ``targets`` names the ``endpoint``, the text ``target`` that goes with it
    (a station number, zips, coordinates or addresses), ``start_date``,
    ``end_date``, ``hourly`` and an optional source preference ``prefer``.
    Requests for stations and zips take their one target and no dates; the
    lists of all of them take nothing.  The key travels in a header, so no
    column holds it.
    """
    endpoint, hourly = F.col("endpoint"), F.col("hourly")
    data = endpoint.endswith("_data")
    point = endpoint.isin("spatial_coordinate_data", "spatial_address_data")
    zips = endpoint.isin("station_zip_data", "spatial_zip_data", "geo_zip_data")
    only = lambda condition: F.when(condition, F.col("target"))
    params = {
        "stationNbrs": only(endpoint == "station_data"),
        "zipCodes": only(zips),
        "coordinates": only(endpoint == "spatial_coordinate_data"),
        "addresses": only(endpoint == "spatial_address_data"),
        "stationNbr": only(endpoint == "station"),
        "zipCode": only(endpoint.isin("station_zip", "spatial_zip")),
        "startDate": F.when(data, normalize_date(F.col("start_date"))),
        "endDate": F.when(data, normalize_date(F.col("end_date"))),
        "isHourly": F.when(data & ~point, F.when(hourly, "true").otherwise("false")),
        "dataItems": measure_list(endpoint, hourly),
        "unitOfMeasure": F.when(data, "M"),
        "prefer": F.when((endpoint == "geo_zip_data") & (F.col("prefer") != ""), F.col("prefer")),
    }
    return (
        targets.withColumn("path", path_of(endpoint))
        .withColumn("items", measure_list(endpoint, hourly))
        .withColumn("query", query_text(params))
        .withColumn("url", F.concat(
            F.lit(base_url.rstrip("/")), "path",
            F.when(F.col("query") == "", "").otherwise(F.concat(F.lit("?"), "query"))))
    )


def yearly(stations: DataFrame, first: int, last: int) -> DataFrame:
    """Station ids times the years asked for, as station requests."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last)))
    return stations.select("station_id", years.alias("year")).select(
        "station_id",
        "year",
        F.lit("station_data").alias("endpoint"),
        F.col("station_id").cast("string").alias("target"),
        F.format_string("%d-01-01", "year").alias("start_date"),
        F.format_string("%d-12-31", "year").alias("end_date"),
        F.lit(False).alias("hourly"),
        F.lit("").alias("prefer"),
    )
