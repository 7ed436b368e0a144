"""Counts of orders that no driver took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scalars import is_unserved, slot_of_day
from .dims import attach_zone


def keyed_orders(
    orders: DataFrame, zones: DataFrame, slot_seconds: int = DEFAULT.slot_seconds, strict: bool = True
) -> DataFrame:
    """Orders with (date, slot, origin, dest): unknown destinations become 0, unknown origins fail."""
    keyed = orders.select(
        F.to_date("ts").alias("date"),
        slot_of_day("ts", slot_seconds).alias("slot"),
        "start_hash",
        "dest_hash",
        "driver_id",
    )
    keyed = attach_zone(keyed, zones, "start_hash", "origin", strict=strict)
    return attach_zone(keyed, zones, "dest_hash", "dest", default=0)


def unserved_or_unknown(driver: str, origin: str, hash_col: str) -> Column:
    """Orders that count; an origin without an id fails before the driver is looked at.

    One expression, so that no optimiser can put the driver's test before the check.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown zone hash: "), F.col(hash_col)))
    return F.when(F.col(origin).isNull(), unknown.cast("boolean")).otherwise(is_unserved(driver))


def gap_counts(
    orders: DataFrame, zones: DataFrame, slot_seconds: int = DEFAULT.slot_seconds, strict: bool = True
) -> DataFrame:
    """Unserved orders per (date, slot, origin, dest); cells without any are absent.

    The origin is resolved before the driver is looked at: a served order from an
    unknown origin fails a strict run too.  Served orders go before the second
    lookup and the count.
    """
    dim = zones.select(F.col("zone_hash").alias("_hash"), F.col("zone_id").alias("origin"))
    placed = orders.join(dim, F.col("start_hash") == F.col("_hash"), "left" if strict else "inner")
    unserved = unserved_or_unknown("driver_id", "origin", "start_hash") if strict else is_unserved("driver_id")
    return count_by_cell(placed.where(unserved), zones, slot_seconds)


def count_by_cell(unserved: DataFrame, zones: DataFrame, slot_seconds: int = DEFAULT.slot_seconds) -> DataFrame:
    """Orders with their origin, counted per (date, slot, origin, dest); unknown destinations are 0."""
    keyed = unserved.select(
        F.to_date("ts").alias("date"), slot_of_day("ts", slot_seconds).alias("slot"), "origin", "dest_hash"
    )
    keyed = attach_zone(keyed, zones, "dest_hash", "dest", default=0)
    return keyed.groupBy("date", "slot", "origin", "dest").agg(F.count(F.lit(1)).alias("gap"))


def served_total(orders: DataFrame) -> DataFrame:
    """Orders with a driver per date."""
    return orders.groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if(~is_unserved("driver_id")).alias("served")
    )


def pack_by_dest(gaps: DataFrame) -> DataFrame:
    """(date, slot, origin, gaps MAP<dest, gap>): at most one entry per destination id."""
    entry = F.struct("dest", "gap")
    return gaps.groupBy("date", "slot", "origin").agg(
        F.map_from_entries(F.collect_list(entry)).alias("gaps")
    )


def join_gap(grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gap counts onto an OD grid; 0 where there are none."""
    keys = ["date", "slot", "origin", "dest"]
    return grid.join(gaps, keys, "left").withColumn("gap", F.coalesce("gap", F.lit(0).cast("bigint")))


def key_frequency(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
