"""Train/test splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def random_split(
    df: DataFrame, weights: tuple[float, float] = (0.8, 0.2), seed: int = 1
) -> list[DataFrame]:
    """Spark's seeded split; it depends on how the rows are partitioned."""
    return df.randomSplit(list(weights), seed=seed)


def in_train(row_id: Column | str, date: Column | str) -> Column:
    """About 80% of rows, by a hash of the row's whole key (date, id): the same in any engine and layout."""
    key = F.concat_ws("|", F.to_date(date).cast("string"), F.col(row_id) if isinstance(row_id, str) else row_id)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 1000 < 800


def hash_split(df: DataFrame, row_id: str, date: Column | str = "date") -> tuple[DataFrame, DataFrame]:
    train = in_train(row_id, date)
    return df.where(train), df.where(~train)


def day_split(
    df: DataFrame, train: list[dt.date], test: list[dt.date], date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """By date: the dates to train on and the dates to test on.  Prunes files partitioned by date."""
    day = F.col(date)
    return df.where(day.isin(train)), df.where(day.isin(test))
