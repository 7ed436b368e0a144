"""From files to the sparse tables that the feature plans start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, GridConfig
from ..functions.scalars import is_unserved, slot_of_day
from ..operators import dims, gaps, grids, latest, poi, quality
from ..operators.forecasts import union_days
from ..session import new_path
from ..sources import readers
from ..sources.readers import Paths
from .forecast import Cleaned


@dataclass(frozen=True)
class RawPaths:
    """A file, a folder or a list of them for each input; orders, traffic and weather are files by day."""

    orders: Paths
    traffic: Paths
    weather: Paths
    zones: Paths
    poi: Paths


def audits(cfg: GridConfig = DEFAULT, **tables: DataFrame) -> DataFrame:
    """(n_rows, n_invalid) of each table: rows whose slot lies outside the calendar."""
    return union_days(
        [
            quality.audit_slots(df, slot_of_day("ts", cfg.slot_seconds), cfg.n_slots).withColumn("source", F.lit(name))
            for name, df in tables.items()
        ]
    )


def clean(
    spark: SparkSession, paths: RawPaths, cfg: GridConfig = DEFAULT, strict: bool = True, scaled_poi: bool = True
) -> tuple[Cleaned, DataFrame]:
    """The cleaned tables of all days, and the audit of what was read.

    Rows without any field are dropped by the readers.  Of rows for one cell the
    last by time wins, then by file path and place in the file.  Unknown origins
    and zones of traffic fail (``strict``), or become ``rejects``: (source, reason,
    zone_hash, row as JSON), written beside the known rows in one pass over each
    input.  Unknown destinations are zone 0.
    """
    last = dims.zone_map(readers.read_zones(spark, paths.zones), n_zones=cfg.n_zones)
    zones = dims.broadcast_if_small(last)
    orders = readers.read_orders(spark, paths.orders)
    traffic = readers.read_traffic(spark, paths.traffic, row_pos=True)
    weather = readers.read_weather(spark, paths.weather, row_pos=True)
    tokens = poi.last_rows(poi.explode_tokens(readers.read_poi(spark, paths.poi)))
    parsed = dims.attach_zone(poi.parse_poi(tokens, ["zone_hash"]), zones, "zone_hash", "zone", strict=False)
    rejects = None
    if strict:
        placed = dims.attach_zone(traffic, zones, "zone_hash", "zone")
        counts = gaps.gap_counts(orders, zones, cfg.slot_seconds)
    else:
        placed, no_zone = dims.known_and_rejected(traffic, zones, "zone_hash", "zone", new_path(spark, "traffic"))
        placed_orders, no_origin = dims.known_and_rejected(orders, zones, "start_hash", "origin", new_path(spark, "orders"))
        counts = gaps.count_by_cell(placed_orders.where(is_unserved("driver_id")), zones, cfg.slot_seconds)
        rejects = union_days([_rejects(no_origin, "orders", "start_hash"), _rejects(no_zone, "traffic", "zone_hash")])
    cleaned = Cleaned(
        grids.distinct_days(orders),
        counts,
        latest.latest_traffic(placed, cfg.slot_seconds, "row_pos"),
        latest.latest_weather(weather, cfg.slot_seconds, "row_pos"),
        poi.poi_pivot(parsed, scaled=scaled_poi),
        rejects,
    )
    return cleaned, audits(cfg, orders=orders, traffic=traffic, weather=weather)


def _rejects(rows: DataFrame, source: str, hash_col: str) -> DataFrame:
    whole = F.to_json(F.struct(*(c for c in rows.columns if c != "reason"))).alias("row")
    return rows.select(F.lit(source).alias("source"), "reason", F.col(hash_col).alias("zone_hash"), whole)
