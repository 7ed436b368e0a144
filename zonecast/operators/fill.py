"""Filling sparse series onto dense slots.

A slot without an observation takes the last one before it; slots before the
first observation take the last one of the day.  An empty traffic zone takes
the last observation of the nearest lower zone that has one, and zeros when no
lower zone has any.  Nothing is carried from one day to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, GridConfig, LEVELS, WEATHER
from ..functions.scalars import day_mod7
from .grids import by_day, day_zones, slot_grid


def _carried_down(part: list[str], value: str, fallback: list[Column]) -> Column:
    """The last non-NULL value up to this slot, else the first non-NULL fallback."""
    up_to_here = (
        Window.partitionBy(*part)
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.coalesce(F.last(value, ignorenulls=True).over(up_to_here), *fallback)


def _pack(cols: list[str]) -> Column:
    """The payload as one struct, so that a fill moves whole observations."""
    return F.struct(*cols)


def fill_by_slot(
    grid: DataFrame, obs: DataFrame, part: list[str], payload: list[str], zero: Column
) -> DataFrame:
    """Fill each group of ``part`` by slot, wrapping round to its own last observation."""
    obs = obs.select(*part, "slot", _pack(payload).alias("_v"))
    cells = grid.join(obs, [*part, "slot"], "left")
    whole = (
        Window.partitionBy(*part)
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    wrap = F.last("_v", ignorenulls=True).over(whole)
    filled = _carried_down(part, "_v", [wrap, zero])
    return cells.select(*part, "slot", filled.alias("_f")).select(*part, "slot", "_f.*")


def fill_weather(days: DataFrame, obs: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """Weather of (date, slot) rows onto every slot of every day."""
    zero = F.struct(
        F.lit(0).alias("weather"), F.lit(0.0).alias("temp"), F.lit(0.0).alias("pollution")
    )
    return fill_by_slot(slot_grid(days, cfg), obs, ["date"], WEATHER, zero)


def weather_grid(days: DataFrame, obs: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """Weather on every slot of every day, NULL where unobserved."""
    return slot_grid(days, cfg).join(obs, ["date", "slot"], "left")


def fill_traffic(
    days: DataFrame,
    obs: DataFrame,
    cfg: GridConfig = DEFAULT,
    leak_carry: bool = True,
    stale_keys: bool = False,
) -> DataFrame:
    """Traffic levels of (date, slot, zone) rows onto every slot and zone of every day.

    ``leak_carry=False`` leaves empty zones at zero.  ``stale_keys=True`` adds
    ``src_day, src_zone, src_slot``: the keys of the row each cell was filled
    from, 0 where there was none.
    """
    payload = list(LEVELS)
    if stale_keys:
        obs = obs.select(
            "*",
            day_mod7("date").alias("src_day"),
            F.col("zone").alias("src_zone"),
            F.col("slot").alias("src_slot"),
        )
        payload = ["src_day", "src_zone", "src_slot", *payload]
    zero = F.struct(*[F.lit(0).alias(c) for c in payload])

    # One row per (date, zone), its observations in a map of at most n_slots entries:
    # the raw rows are read once for both the carry and the cells.
    packed = obs.groupBy("date", "zone").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", _pack(payload)))).alias("_seen"),
        F.max_by(_pack(payload), "slot").alias("_last"),
    )
    zones = by_day(day_zones(days, cfg).join(packed, ["date", "zone"], "left"))
    carry = F.col("_last")
    if leak_carry:
        below = (
            Window.partitionBy("date")
            .orderBy("zone")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        carry = F.last(carry, ignorenulls=True).over(below)
    carried = zones.select("date", "zone", "_seen", F.coalesce(carry, zero).alias("_carry"))

    slots = F.explode(F.sequence(F.lit(1), F.lit(cfg.n_slots))).alias("slot")
    cells = carried.select("*", slots).select(
        "date", "zone", "slot", "_carry", F.try_element_at("_seen", F.col("slot")).alias("_v")
    )
    filled = _carried_down(["date", "zone"], "_v", [F.col("_carry")])
    return cells.select("date", "slot", "zone", filled.alias("_f")).select(
        "date", "slot", "zone", "_f.*"
    )
