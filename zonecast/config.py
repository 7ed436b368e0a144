"""Grid shape, column lists and fixed scaling values."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

SECONDS_PER_DAY = 86_400


@dataclass(frozen=True)
class GridConfig:
    """Calendar and zone shape shared by every job.

    A day has ``n_slots`` slots of ``slot_seconds``; origins are zones
    ``1..n_zones``; destinations are ``0..n_zones`` where 0 means "outside the
    city or unknown".  Origin and destination must stay below 100, because the
    OD index is ``slot * 10000 + origin * 100 + dest``.
    """

    slot_seconds: int = 600
    n_zones: int = 66

    def __post_init__(self):
        if SECONDS_PER_DAY % self.slot_seconds:
            raise ValueError("slot_seconds must divide a day")
        if not 0 < self.n_zones < 100:
            raise ValueError("n_zones must be in 1..99")

    @property
    def n_slots(self) -> int:
        return SECONDS_PER_DAY // self.slot_seconds


DEFAULT = GridConfig()

# A dimension is broadcast only after a count showed it is at most this long.
MAX_BROADCAST_ROWS = 100_000



def month_dates(days: Iterable[int], year: int = 2024, month: int = 1) -> list[dt.date]:
    """Dates of one month."""
    return [dt.date(year, month, d) for d in days]


TRAIN_DAYS = month_dates(range(1, 22))
TEST_DAYS = month_dates([22, 24, 26, 28, 30])

LEVELS = ["t1", "t2", "t3", "t4"]
WEATHER = ["weather", "temp", "pollution"]

# Divisors of the four traffic levels.
TRAFFIC_DIVISORS = {"t1": 2000.0, "t2": 1000.0, "t3": 400.0, "t4": 200.0}

# Fixed value: model-predicted traffic is divided by this where nothing was observed.
PREDICTED_TRAFFIC_DIVISOR = 4.0

# Divisor of each top category 1..25, as (maximum, subcategory count).
POI_DIVISORS = {
    1: (86071.0, 12.0),
    2: (30544.0, 13.0),
    3: (6640.0, 6.0),
    4: (152803.0, 18.0),
    5: (21165.0, 5.0),
    6: (61005.0, 5.0),
    7: (35026.0, 4.0),
    8: (91217.0, 6.0),
    9: (1.0, 1.0),
    10: (25.0, 1.0),
    11: (419980.0, 9.0),
    12: (166.0, 1.0),
    13: (85739.0, 6.0),
    14: (40172.0, 10.0),
    15: (141515.0, 9.0),
    16: (152056.0, 13.0),
    17: (105410.0, 6.0),
    18: (83.0, 1.0),
    19: (502731.0, 6.0),
    20: (678110.0, 10.0),
    21: (830.0, 3.0),
    22: (34445.0, 7.0),
    23: (32619.0, 7.0),
    24: (490198.0, 4.0),
    25: (60839.0, 10.0),
}
POI_CATEGORIES = list(range(1, 26))
POI_MAX_SUB = 20
# Category 9 is rolled up but never part of a feature table.
POI_COLUMNS = [str(c) for c in POI_CATEGORIES if c != 9]

GAP_COLUMNS = (
    ["id", "timeslice", "districtID", "destDistrict", "day", "gap"]
    + ["traffic1", "traffic2", "traffic3", "traffic4"]
    + ["weather", "temp", "pollution"]
    + POI_COLUMNS
)
TRAFFIC_COLUMNS = ["day", "district", "timeslice"] + LEVELS + ["temp", "pollution"] + POI_COLUMNS
