"""Rescaling of traffic and weather columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRAFFIC_DIVISORS
from ..functions.scalars import clamp_temp, scaled_pollution, scaled_temperature


def scale_traffic(df: DataFrame, divisors: dict[str, float] = TRAFFIC_DIVISORS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") / d for c, d in divisors.items()})


def scale_weather(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"temp": scaled_temperature("temp"), "pollution": scaled_pollution("pollution")}
    )


def raw_weather(df: DataFrame) -> DataFrame:
    return df.withColumn("temp", clamp_temp("temp"))
