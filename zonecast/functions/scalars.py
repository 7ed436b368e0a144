"""Scalar operators.  Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, PREDICTED_TRAFFIC_DIVISOR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


# -- time ---------------------------------------------------------------------


def seconds_of_day(ts) -> Column:
    ts = _col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def slot_of_day(ts, slot_seconds: int = DEFAULT.slot_seconds) -> Column:
    """1-based slot of the day; 00:00:00 is slot 1."""
    return _int_div(seconds_of_day(ts), slot_seconds) + 1


def day_mod7(ts) -> Column:
    """Day of month modulo 7 (not a weekday)."""
    return F.dayofmonth(_col(ts)) % 7


def day_label(day) -> Column:
    """Two-digit day number."""
    return F.lpad(_col(day).cast("string"), 2, "0")


def slot_label(date, slot) -> Column:
    """``2016-01-22_17``: date, underscore, slot."""
    return F.concat_ws("_", _col(date).cast("string"), _col(slot).cast("string"))


def label_from_name(name) -> Column:
    """The ``yyyy-MM-dd_`` part of a file name such as ``final_day_2016-01-22_test.csv``."""
    return F.substring(_col(name), 11, 11)


# -- keys ---------------------------------------------------------------------


def od_encode(slot, origin, dest) -> Column:
    return _col(slot) * 10000 + _col(origin) * 100 + _col(dest)


def od_decode(idx) -> Column:
    idx = _col(idx)
    return F.struct(
        _int_div(idx, 10000).alias("slot"),
        _int_div(idx % 10000, 100).alias("origin"),
        (idx % 100).cast("int").alias("dest"),
    )


def zone_slot_key(slot, zone) -> Column:
    return _col(slot) * 100 + _col(zone)


# -- token parsing ------------------------------------------------------------


def parse_level(token, strict: bool = True) -> Column:
    """The integer after the colon of ``"k:v"``.

    Strict mode relies on ANSI mode: a bad token fails the job.  Lenient mode
    gives NULL.  (``split`` with an index is several times faster than ``split_part``.)
    """
    parts = F.split(_col(token), ":")
    return parts[1].cast("int") if strict else F.try_element_at(parts, F.lit(2)).try_cast("int")


def is_blank(token) -> Column:
    token = _col(token)
    return token.isNull() | (F.trim(token) == "")


# -- rescaling ----------------------------------------------------------------


def scaled_temperature(t) -> Column:
    return (F.lit(20.0) + _col(t)) / 40.0


def scaled_pollution(p) -> Column:
    return _col(p) / 100.0


def clamp_temp(t) -> Column:
    """Negative temperatures become 0; NULL stays NULL."""
    t = _col(t)
    return F.when(t < 0, F.lit(0.0)).otherwise(t)


# -- conditionals -------------------------------------------------------------


def observed_or(observed, predicted, divisor: float = PREDICTED_TRAFFIC_DIVISOR) -> Column:
    return F.coalesce(_col(observed), _col(predicted) / divisor)


def cut_small(predict, floor: float = 0.5) -> Column:
    """Predictions under ``floor`` become 0; NULL stays NULL."""
    predict = _col(predict)
    return F.when(predict < floor, F.lit(0.0)).otherwise(predict)


def abs_error(predict, gap) -> Column:
    return F.abs(_col(predict) - _col(gap))


def is_unserved(driver) -> Column:
    """The order log writes the text ``NULL`` for a missing driver."""
    return _col(driver) == "NULL"
