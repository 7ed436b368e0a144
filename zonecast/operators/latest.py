"""Last-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scalars import parse_level, slot_of_day


def micros_of_day(ts: str) -> Column:
    """Microseconds since midnight, without a detour over a time zone."""
    whole = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    return whole + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def last_by(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """Per key, the payload of the row with the largest value of one order column."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in payload])


def last_wins(
    df: DataFrame,
    keys: list[str],
    ts: str,
    row_id: str,
    payload: list[str],
    span_seconds: int = DEFAULT.slot_seconds,
    file_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Per key, the payload of the row with the largest (ts, file_cols, row_id).

    ``keys`` must pin rows to one day and one span of ``span_seconds``, as every
    slot key does; ``row_id`` is a BIGINT >= 0 given out in load order.

    A struct as order would make Spark sort the raw rows (its buffer cannot live
    in a hash aggregate).  So the order is one BIGINT: microsecond within the span
    above as many low bits of row_id as fit.  The high bits of row_id join the
    key of this first, hash-aggregated pass; a second pass picks the winner among
    the few rows left per key.  ``file_cols`` (the file and split of a row) join the
    key of the first pass too.
    """
    span = span_seconds * 1_000_000
    low = 63 - span.bit_length()
    packed = F.shiftleft(micros_of_day(ts) % span, low).bitwiseOR(
        F.col(row_id).bitwiseAND(F.lit((1 << low) - 1))
    )
    first = last_by(
        df.withColumn("_o", packed).withColumn("_hi", F.shiftright(row_id, low)),
        [*keys, *file_cols, "_hi"],
        "_o",
        [*payload, "_o"],
    )
    order = F.struct(F.shiftright("_o", low), *file_cols, F.col("_hi"), F.col("_o"))
    return (
        first.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), order).alias("_p"))
        .select(*keys, "_p.*")
    )


def _row_order(row_id: str) -> tuple[list[Column], str, tuple[str, ...]]:
    """The columns that order rows of equal time: an id, or the ``row_pos`` that readers give."""
    if row_id != "row_pos":
        return [F.col(row_id)], row_id, ()
    named = {"file": "_file", "start": "_start", "row": "_row"}
    return [F.col(f"row_pos.{k}").alias(v) for k, v in named.items()], "_row", ("_file", "_start")


def latest_traffic(
    traffic: DataFrame, slot_seconds: int = DEFAULT.slot_seconds, row_id: str = "event_id"
) -> DataFrame:
    """Traffic rows with a ``zone`` id -> integer levels, one row per (date, slot, zone)."""
    order, row_id, file_cols = _row_order(row_id)
    parsed = traffic.select(
        F.to_date("ts").alias("date"),
        slot_of_day("ts", slot_seconds).alias("slot"),
        "zone",
        *[parse_level(f"level{i}").alias(f"t{i}") for i in (1, 2, 3, 4)],
        "ts",
        *order,
    )
    levels = ["t1", "t2", "t3", "t4"]
    return last_wins(parsed, ["date", "slot", "zone"], "ts", row_id, levels, slot_seconds, file_cols)


def latest_weather(
    weather: DataFrame, slot_seconds: int = DEFAULT.slot_seconds, row_id: str = "event_id"
) -> DataFrame:
    """Weather rows -> one row per (date, slot), in raw units."""
    order, row_id, file_cols = _row_order(row_id)
    keyed = weather.select(
        F.to_date("ts").alias("date"),
        slot_of_day("ts", slot_seconds).alias("slot"),
        "weather",
        F.col("temperature").alias("temp"),
        "pollution",
        "ts",
        *order,
    )
    fields = ["weather", "temp", "pollution"]
    return last_wins(keyed, ["date", "slot"], "ts", row_id, fields, slot_seconds, file_cols)
