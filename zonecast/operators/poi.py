"""Points of interest: tokens ``"cat:n"`` or ``"cat#sub:n"`` rolled up to top categories per zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import POI_CATEGORIES, POI_COLUMNS, POI_DIVISORS, POI_MAX_SUB
from ..functions.scalars import is_blank

CANONICAL_KEY = r"^[1-9][0-9]*(#[1-9][0-9]*)?$"


def explode_tokens(poi: DataFrame) -> DataFrame:
    """Ragged rows to one row per token: (zone_hash, row_pos, pos, token).

    A row without tokens stays, with a NULL token: its zone is known to exist.
    """
    return poi.select("zone_hash", "row_pos", F.posexplode_outer("tokens").alias("pos", "token"))


def last_rows(tokens: DataFrame, zone: str = "zone_hash") -> DataFrame:
    """Where a zone has several input rows, keep the tokens of the last one."""
    last = tokens.groupBy(zone).agg(F.max("row_pos").alias("row_pos"))
    return tokens.join(last, [zone, "row_pos"], "left_semi")


def parse_poi(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., cat, sub, n), one row per distinct token key; the largest ``pos`` wins.

    ``sub`` is 0 for a bare category.  A zone whose tokens are all blank keeps one
    row with NULL cat, sub and n; so do keys that are not of the two known forms.
    """
    token = F.col("token")
    pair = F.split(token, ":")
    steps = F.split(pair[0], "#")
    known = ~is_blank(token) & pair[0].rlike(CANONICAL_KEY)
    sub = F.when(F.size(steps) == 1, F.lit(0)).otherwise(
        F.try_element_at(steps, F.lit(2)).try_cast("int")
    )
    parsed = tokens.select(
        *keys,
        "pos",
        F.when(known, steps[0].try_cast("int")).alias("cat"),
        F.when(known, sub).alias("sub"),
        F.when(~is_blank(token), pair[1].cast("int")).alias("n"),
    )
    latest = parsed.groupBy(*keys, "cat", "sub").agg(F.max_by("n", "pos").alias("n"))
    return latest.withColumn("n", F.when(F.col("cat").isNotNull(), F.col("n")))


def _wide(parsed: DataFrame, zone: str) -> DataFrame:
    """One row per zone with the sum of every top category."""
    kept = F.col("sub") <= POI_MAX_SUB
    sums = [
        F.coalesce(F.sum(F.when(kept & (F.col("cat") == c), F.col("n").cast("bigint"))), F.lit(0))
        .cast("bigint")
        .alias(str(c))
        for c in POI_CATEGORIES
    ]
    return parsed.groupBy(zone).agg(*sums)


def scale_poi(wide: DataFrame, divisors: dict[int, tuple[float, float]] = POI_DIVISORS) -> DataFrame:
    """Divide each category by its own divisor."""
    return wide.withColumns(
        {str(c): F.col(f"`{c}`").cast("double") / F.lit(a / b) for c, (a, b) in divisors.items()}
    )


def _long(wide: DataFrame, zone: str, value: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("cat"), F.col(f"`{c}`").alias(value)) for c in POI_CATEGORIES
    ]
    return wide.select(zone, F.inline(F.array(*cells)))


def poi_rollup(parsed: DataFrame, zone: str = "zone", scaled: bool = False) -> DataFrame:
    """(zone, cat, n) for all 25 categories of every zone that occurs."""
    wide = _wide(parsed, zone)
    return _long(scale_poi(wide) if scaled else wide, zone, "n")


def poi_pivot(parsed: DataFrame, zone: str = "zone", scaled: bool = True) -> DataFrame:
    """One row per zone with the 24 columns of the feature tables."""
    wide = _wide(parsed, zone)
    wide = scale_poi(wide) if scaled else wide
    return wide.select(zone, *[F.col(f"`{c}`") for c in POI_COLUMNS])

