"""Readers.  All take one path or a list of paths, declare their schema, and fail on bad rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import drop_all_null
from . import schemas

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
Paths = str | list[str]


def _tsv(
    spark: SparkSession, path: Paths, schema: T.StructType, file_day: bool, row_pos: bool = False
) -> DataFrame:
    """Rows of which at least one field is there."""
    df = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )
    df = with_file_day(df) if file_day else df
    df = with_row_pos(df) if row_pos else df
    return drop_all_null(df, schema.names)


def with_row_pos(df: DataFrame) -> DataFrame:
    """Add ``row_pos``, the place of a row over all files: file path, start of its split, row in it.

    Spark may read large files first, so a running id alone is no file order; and
    files of two folders may share a name.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return df.withColumn("row_pos", F.struct(*place, F.monotonically_increasing_id().alias("row")))


def with_file_day(df: DataFrame, out: str = "date") -> DataFrame:
    """Add the date that the name of the source file carries."""
    name = F.col("_metadata.file_name")
    return df.withColumn(out, F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).cast("date"))


def read_orders(spark: SparkSession, path: Paths, file_day: bool = False, row_pos: bool = False) -> DataFrame:
    """Order log, tab separated.  The text ``NULL`` in driver_id is a value, not a SQL NULL."""
    return _tsv(spark, path, schemas.ORDERS, file_day, row_pos)


def read_traffic(spark: SparkSession, path: Paths, file_day: bool = False, row_pos: bool = False) -> DataFrame:
    """Traffic levels as ``"k:v"`` text, tab separated."""
    return _tsv(spark, path, schemas.TRAFFIC, file_day, row_pos)


def read_weather(spark: SparkSession, path: Paths, file_day: bool = False, row_pos: bool = False) -> DataFrame:
    return _tsv(spark, path, schemas.WEATHER, file_day, row_pos)


def read_zones(spark: SparkSession, path: Paths) -> DataFrame:
    """Hash and id of each zone; ``row_pos`` tells which of several rows is the last."""
    raw = _tsv(spark, path, schemas.ZONES_TEXT, file_day=False, row_pos=True)
    return raw.select("zone_hash", F.trim("zone_id").cast("int").alias("zone_id"), "row_pos")


def read_poi(spark: SparkSession, path: Paths) -> DataFrame:
    """Ragged rows: zone hash, then any number of tokens.  ``row_pos`` keeps the file order."""
    parts = F.split("value", "\t")
    return with_row_pos(spark.read.text(path)).select(
        parts[0].alias("zone_hash"),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("tokens"),
        "row_pos",
    )


def _table(spark: SparkSession, path: Paths, schema: T.StructType, fmt: str) -> DataFrame:
    """A table written by ``write_daily``: the schema's columns plus the partition column ``date``."""
    full = T.StructType(schema.fields + [T.StructField("date", T.DateType(), True)])
    reader = spark.read.schema(full)
    if fmt == "csv":
        # enforceSchema off: a header that does not match the schema fails the job
        reader = (
            reader.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        )
    return reader.format(fmt).load(path)


def read_features(spark: SparkSession, path: Paths, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.GAP_FEATURES, fmt)


def read_traffic_features(spark: SparkSession, path: Paths, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.TRAFFIC_FEATURES, fmt)


def read_weather_grid(spark: SparkSession, path: Paths, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.WEATHER_GRID, fmt)


def read_scored_traffic(spark: SparkSession, path: Paths, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.SCORED_TRAFFIC, fmt)


def read_forecast(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    return _table(spark, path, schemas.FORECAST, fmt)


def select_days(df: DataFrame, days: Iterable[dt.date], date_col: str = "date") -> DataFrame:
    """Keep the given dates.  On a ``date`` partition column this prunes files."""
    return df.where(F.col(date_col).isin(list(days)))


def zone_dim(spark: SparkSession) -> DataFrame:
    """The built-in zone dimension: 66 hashes with their ids."""
    from .zone_table import ZONE_HASHES

    rows = list(enumerate(ZONE_HASHES, start=1))
    return spark.createDataFrame(rows, "zone_id int, zone_hash string").select("zone_hash", "zone_id")
