"""One StructType per entity."""

from __future__ import annotations

from pyspark.sql import types as T

from ..config import GAP_COLUMNS, LEVELS, TRAFFIC_COLUMNS

STR, INT, LONG, DBL, NTZ = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDERS = _struct(
    ("order_id", STR), ("driver_id", STR), ("passenger_id", STR),
    ("start_hash", STR), ("dest_hash", STR), ("price", DBL), ("ts", NTZ),
)

TRAFFIC = _struct(
    ("zone_hash", STR), ("level1", STR), ("level2", STR),
    ("level3", STR), ("level4", STR), ("ts", NTZ),
)

WEATHER = _struct(("ts", NTZ), ("weather", INT), ("temperature", DBL), ("pollution", DBL))

# The id is padded with blanks in the wild: read as text, then trimmed and cast.
ZONES_TEXT = _struct(("zone_hash", STR), ("zone_id", STR))

_GAP_INTS = {"id", "timeslice", "districtID", "destDistrict", "day", "weather"}
GAP_FEATURES = _struct(
    *[(c, LONG if c == "gap" else INT if c in _GAP_INTS else DBL) for c in GAP_COLUMNS]
)
TRAFFIC_FEATURES = _struct(
    *[(c, INT if c in ("day", "district", "timeslice") else DBL) for c in TRAFFIC_COLUMNS]
)
WEATHER_GRID = _struct(
    ("day", INT), ("timeslice", INT), ("weather", INT), ("temp", DBL), ("pollution", DBL)
)
SCORED_TRAFFIC = _struct(
    ("district", INT), ("timeslice", INT),
    *[(c, DBL) for c in LEVELS], *[(c + "p", DBL) for c in LEVELS],
)
FORECAST = _struct(("timeslice", INT), ("districtID", INT), ("gap", LONG), ("predict", DBL))
