"""Feature tables.

The gap matrix has one row per (day, slot, origin, destination), 636,768 a day.
Everything is joined at zone grain, 67 times smaller, with the gap counts of a
zone packed into a map; the destinations are exploded last, so no shuffle or
join ever sees the full matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, GAP_COLUMNS, LEVELS, TRAFFIC_COLUMNS, GridConfig
from ..functions.scalars import day_mod7, observed_or, od_encode
from ..operators.fill import fill_traffic, fill_weather, weather_grid
from ..operators.gaps import pack_by_dest
from ..operators.grids import add_dests, spread, zone_grid
from ..operators.scale import raw_weather, scale_traffic, scale_weather


def _quoted(cols: list[str]) -> list[str]:
    return [f"`{c}`" for c in cols]


def join_weather(cells: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather by (date, slot); NULL where absent."""
    return cells.join(weather, ["date", "slot"], "left")


def join_traffic(cells: DataFrame, traffic: DataFrame) -> DataFrame:
    """Traffic by (date, slot, zone); NULL where absent."""
    return cells.join(traffic, ["date", "slot", "zone"], "left")


def join_poi(cells: DataFrame, poi: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """POI columns by zone: NULL for zones without POI.

    ``poi`` has one row per zone id, at most ``n_zones`` after the filter, so the
    broadcast is bounded whatever the input size.
    """
    bounded = poi.where(F.col("zone").between(1, cfg.n_zones))
    return cells.join(F.broadcast(bounded), "zone", "left")


NAMES = {"slot": "timeslice", "zone": "districtID", "dest": "destDistrict", **{f"t{i}": f"traffic{i}" for i in (1, 2, 3, 4)}}


def _packed(cells: DataFrame, weather: DataFrame, gaps: DataFrame, poi: DataFrame, cfg: GridConfig) -> DataFrame:
    """Zone grain: every feature that the destinations of a cell share, and ``gaps``, the map of those with a gap."""
    packed = pack_by_dest(gaps).withColumnRenamed("origin", "zone")
    wide = cells.join(packed, ["date", "slot", "zone"], "left")
    wide = spread(join_weather(wide, weather), cfg)
    return join_poi(wide, poi, cfg).withColumn("day", day_mod7("date"))


def packed_matrix(wide: DataFrame) -> DataFrame:
    """Packed cells under the names of the gap matrix: (date, its columns but id, destDistrict and gap; gaps)."""
    columns = [c for c in GAP_COLUMNS if c not in ("id", "destDistrict", "gap")]
    return wide.withColumnsRenamed(NAMES).select("date", *_quoted(columns), "gaps")


def _gap_matrix(
    cells: DataFrame, weather: DataFrame, gaps: DataFrame, poi: DataFrame, cfg: GridConfig, packed: bool = False
) -> DataFrame:
    wide = _packed(cells, weather, gaps, poi, cfg)
    if packed:
        return packed_matrix(wide)
    gap = F.coalesce(F.try_element_at("gaps", F.col("dest")), F.lit(0).cast("bigint"))
    rows = add_dests(wide, cfg).withColumns({"id": od_encode("slot", "zone", "dest"), "gap": gap})
    return rows.withColumnsRenamed(NAMES).select("date", *_quoted(GAP_COLUMNS))


def features_raw(
    days: DataFrame,
    gaps: DataFrame,
    traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
    packed: bool = False,
) -> DataFrame:
    """Gap matrix in raw units: negative temperatures clamped, levels and POI counts unscaled.

    ``gaps``, ``traffic`` and ``weather`` are the sparse tables of ``gap_counts``,
    ``latest_traffic`` and ``latest_weather``; ``poi`` is an unscaled pivot.
    ``packed`` gives the cells before the destinations are exploded.
    """
    weather = fill_weather(days, raw_weather(weather), cfg)
    return _gap_matrix(fill_traffic(days, traffic, cfg), weather, gaps, poi, cfg, packed)


def features_norm(
    days: DataFrame,
    gaps: DataFrame,
    traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
    packed: bool = False,
) -> DataFrame:
    """Gap matrix with rescaled traffic, weather and POI, traffic filled."""
    weather = fill_weather(days, scale_weather(weather), cfg)
    cells = scale_traffic(fill_traffic(days, traffic, cfg))
    return _gap_matrix(cells, weather, gaps, poi, cfg, packed)


def features_test(
    days: DataFrame,
    gaps: DataFrame,
    scored_traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
    packed: bool = False,
) -> DataFrame:
    """Gap matrix of days to forecast.

    Traffic is the observed level, else the predicted one over 4; it is not
    filled, so a cell absent from ``scored_traffic`` (date, slot, zone, t1..t4,
    t1p..t4p) stays NULL.
    """
    weather = fill_weather(days, scale_weather(weather), cfg)
    levels = scored_traffic.select(
        "date", "slot", "zone", *[observed_or(t, t + "p").alias(t) for t in LEVELS]
    )
    cells = join_traffic(zone_grid(days, cfg), levels)
    return _gap_matrix(cells, weather, gaps, poi, cfg, packed)


# -- traffic tables -----------------------------------------------------------


def _traffic_table(
    cells: DataFrame, weather: DataFrame, poi: DataFrame, cfg: GridConfig, stale: bool = False
) -> DataFrame:
    weather = weather.select("date", "slot", "temp", "pollution")
    wide = join_poi(join_weather(cells, weather), poi, cfg)
    keys = (
        [F.col("src_day").alias("day"), F.col("src_zone").alias("district"), F.col("src_slot")]
        if stale
        else [day_mod7("date").alias("day"), F.col("zone").alias("district"), F.col("slot")]
    )
    keys[2] = keys[2].alias("timeslice")
    return wide.select("date", *keys, *_quoted(TRAFFIC_COLUMNS[3:]))


def traffic_train(
    days: DataFrame,
    traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
    stale_keys: bool = False,
) -> DataFrame:
    """Dense traffic table of training days.

    ``stale_keys=True`` gives filled rows the day, district and slot of the row
    they were filled from, while weather and POI stay those of the grid cell.
    """
    weather = fill_weather(days, scale_weather(weather), cfg)
    cells = scale_traffic(fill_traffic(days, traffic, cfg, stale_keys=stale_keys))
    return _traffic_table(cells, weather, poi, cfg, stale_keys)


def traffic_observed(
    days: DataFrame,
    traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
) -> DataFrame:
    """Only the observed cells of test days."""
    weather = fill_weather(days, scale_weather(weather), cfg)
    return _traffic_table(scale_traffic(traffic), weather, poi, cfg)


def traffic_predict_grid(
    days: DataFrame,
    traffic: DataFrame,
    weather: DataFrame,
    poi: DataFrame,
    cfg: GridConfig = DEFAULT,
) -> DataFrame:
    """Every cell of the days to predict; levels NULL where unobserved."""
    weather = fill_weather(days, scale_weather(weather), cfg)
    cells = join_traffic(zone_grid(days, cfg), scale_traffic(traffic))
    return _traffic_table(cells, weather, poi, cfg)


def weather_table(days: DataFrame, weather: DataFrame, cfg: GridConfig = DEFAULT) -> DataFrame:
    """Unfilled weather grid; ``day`` is the day of the month here, not modulo 7."""
    return weather_grid(days, weather, cfg).select(
        "date",
        F.dayofmonth("date").alias("day"),
        F.col("slot").alias("timeslice"),
        "weather",
        "temp",
        "pollution",
    )

