"""Validity of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.schemas import MAX_HUMIDITY, MAX_TS, TEMPERATURE_BOUNDS


def is_valid(kind: str) -> Column:
    return (
        (F.col("station_id") != 0)
        & (F.col("ts") <= MAX_TS[kind])
        & F.col("temperature").between(*TEMPERATURE_BOUNDS)
        & (F.col("humidity") <= MAX_HUMIDITY)
    )


def valid(obs: DataFrame, kind: str) -> DataFrame:
    return obs.where(is_valid(kind))


def invalid(obs: DataFrame, kind: str) -> DataFrame:
    return obs.where(~is_valid(kind))
