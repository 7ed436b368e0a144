"""Views over the driver tables that play the engine's inputs.

Each text runs unchanged in Spark and in DuckDB (``{table}`` names a driver
table), so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .config import DEFAULT, GridConfig
from .operators import dims, gaps, grids, latest, poi

VIEWS = {
    "zones": """
SELECT md5('z' || CAST(z AS VARCHAR(9))) AS zone_hash, CAST(z AS INT) AS zone_id
FROM (SELECT DISTINCT p_partkey % 66 + 1 AS z FROM {part}) d""",
    # Each hash many times; only its last row (largest pos) has the right id.
    "zone_log": """
SELECT p_partkey AS pos, md5('z' || CAST(p_partkey % 66 + 1 AS VARCHAR(9))) AS zone_hash,
       CAST(CASE WHEN p_partkey = max(p_partkey) OVER (PARTITION BY p_partkey % 66)
                 THEN p_partkey % 66 + 1 ELSE p_partkey * 7 % 66 + 1 END AS INT) AS zone_id
FROM {part}""",
    "ride_orders": """
SELECT CAST(event_id AS VARCHAR(20)) AS order_id,
       CASE WHEN event_type = 'error' THEN 'NULL' ELSE 'd' || CAST(user_id AS VARCHAR(20)) END AS driver_id,
       CAST(user_id AS VARCHAR(20)) AS passenger_id,
       md5('z' || CAST(user_id % 66 + 1 AS VARCHAR(9))) AS start_hash,
       md5('z' || CAST(event_id * 7 % 80 + 1 AS VARCHAR(9))) AS dest_hash,
       value AS price, ts, event_id
FROM {events}""",
    "traffic_raw": """
SELECT md5('z' || CAST(user_id % 66 + 1 AS VARCHAR(9))) AS zone_hash,
       '1:' || CAST(CAST(floor(value * 10) AS INT) AS VARCHAR(9)) AS level1,
       '2:' || CAST(CAST(floor(value * 5) AS INT) AS VARCHAR(9)) AS level2,
       '3:' || CAST(CAST(floor(value * 2) AS INT) AS VARCHAR(9)) AS level3,
       '4:' || CAST(CAST(floor(value) AS INT) AS VARCHAR(9)) AS level4,
       ts, event_id
FROM {events}""",
    "weather_raw": """
SELECT ts, CAST(event_id % 9 + 1 AS INT) AS weather, value / 10 - 5 AS temperature,
       value / 3 + 20 AS pollution, event_id
FROM {events}""",
    "poi_tokens_raw": """
SELECT md5('z' || CAST(p_partkey % 66 + 1 AS VARCHAR(9))) AS zone_hash, p_partkey AS pos,
       regexp_extract(p_brand, '([0-9]+)', 1)
         || CASE WHEN p_size % 23 = 0 THEN '' ELSE '#' || CAST(p_size % 23 AS VARCHAR(9)) END
         || ':' || CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(9)) AS token
FROM {part}""",
    "scored_cells": """
SELECT CAST(day(ts) AS INT) AS day,
       CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 600) + 1 AS INT) AS slot,
       CAST(user_id % 66 + 1 AS INT) AS zone, CAST(event_id * 7 % 67 AS INT) AS dest,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS gap, value / 100 AS predict
FROM {events}""",
    "daily_series": """
SELECT event_type AS key, CAST(day(ts) AS INT) AS t, CAST(count(*) AS DOUBLE) AS x, round(sum(value), 2) AS y
FROM {events} GROUP BY event_type, CAST(day(ts) AS INT)""",
}


class Inputs:
    """The fixture inputs of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: GridConfig = DEFAULT):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        tables = {t: self.table(t) for t in ("events", "part") if f"{{{t}}}" in text}
        return self.spark.sql(text, **tables)

    @cached_property
    def zones(self) -> DataFrame:
        """Zone dimension; counted once, then hinted for broadcast."""
        return dims.broadcast_if_small(dims.zone_map(self.view("zones"), "zone_id"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.view("ride_orders")

    @cached_property
    def days(self) -> DataFrame:
        return grids.distinct_days(self.table("events"))

    @cached_property
    def gaps(self) -> DataFrame:
        return gaps.gap_counts(self.orders, self.zones, self.cfg.slot_seconds)

    @cached_property
    def traffic(self) -> DataFrame:
        known = dims.attach_zone(self.view("traffic_raw"), self.zones, "zone_hash", "zone")
        return latest.latest_traffic(known, self.cfg.slot_seconds)

    @cached_property
    def weather(self) -> DataFrame:
        return latest.latest_weather(self.view("weather_raw"), self.cfg.slot_seconds)

    @cached_property
    def poi(self) -> DataFrame:
        """Parsed tokens with zone ids; the hash is resolved after de-duplication."""
        parsed = poi.parse_poi(self.view("poi_tokens_raw"), ["zone_hash"])
        return dims.attach_zone(parsed, self.zones, "zone_hash", "zone")
