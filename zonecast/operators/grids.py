"""Dense calendar grids.

A grid is grown from its day table.  Zone grain (9,504 cells a day) is spread
over tasks before destinations multiply it by 67.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, GridConfig


def distinct_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Days that occur.  Rows without a time have none."""
    return df.select(F.to_date(ts).alias("date")).where("date IS NOT NULL").distinct()


def _one_to(n: int):
    return F.explode(F.sequence(F.lit(1), F.lit(n)))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_day(rows: DataFrame) -> DataFrame:
    """Shuffle small per-day tables by date ahead of an explode into slots.

    The windows by date that follow reuse this partitioning.  The number of tasks
    is given, because AQE would otherwise judge by the size before the explode.
    """
    return rows.repartition(_tasks(rows), "date")


BLOCKS_PER_DAY = 12


def spread(cells: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """Shuffle zone-grain cells by (date, block of slots), ahead of an explode.

    Destinations multiply the rows by 67, so the shuffle belongs before them, again
    with a given number of tasks.  A day is spread over at most ``BLOCKS_PER_DAY``
    of them, which also bounds the files a daily write makes.
    """
    block = F.floor((F.col("slot") - 1) * BLOCKS_PER_DAY / cfg.n_slots)
    return cells.repartition(_tasks(cells), "date", block)


def slot_grid(days: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """(date, slot)"""
    return days.select("date", _one_to(cfg.n_slots).alias("slot"))


def day_zones(days: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """(date, zone)"""
    return days.select("date", _one_to(cfg.n_zones).alias("zone"))


def zone_grid(days: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """(date, slot, zone)"""
    return slot_grid(days, cfg).select("date", "slot", _one_to(cfg.n_zones).alias("zone"))


def add_dests(cells: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """Every cell once per destination 0..n_zones; a narrow step."""
    return cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_zones))).alias("dest"))


def od_grid(days: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """(date, slot, origin, dest)"""
    cells = spread(zone_grid(days, cfg), cfg)
    return add_dests(cells.withColumnRenamed("zone", "origin"), cfg)
