"""Work on scored rows: threshold, roll-up, error, union and merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import abs_error, cut_small, slot_label

FORECAST_KEYS = ["date", "timeslice", "districtID"]


def forecast_rollup(
    scored: DataFrame, cut: float | None = 0.5, keys: list[str] = FORECAST_KEYS
) -> DataFrame:
    """Sum gap and prediction over destinations; predictions under ``cut`` count as 0."""
    predict = F.col("predict") if cut is None else cut_small("predict", cut)
    return scored.groupBy(*keys).agg(
        F.sum(F.col("gap").cast("bigint")).alias("gap"), F.sum(predict).alias("predict")
    )


def mean_abs_error(rollup: DataFrame, by: str = "date") -> DataFrame:
    return rollup.groupBy(by).agg(F.avg(abs_error("predict", "gap")).alias("mae"))


def first_rows(rollup: DataFrame, n: int = 20, keys: list[str] = FORECAST_KEYS) -> DataFrame:
    """A look at the first cells, in key order (a top-k in Spark's plan, not a sort)."""
    return rollup.orderBy(*keys).limit(n)


def union_days(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def merge_forecasts(
    forecast: DataFrame, date: str = "date", slot: str = "timeslice", zone: str = "districtID"
) -> DataFrame:
    """Forecasts of many days as one table, each slot labelled with its date."""
    return forecast.select(
        slot_label(date, slot).alias("timeslice"), F.col(zone).alias("districtID"), "gap", "predict"
    )
