from __future__ import annotations

import datetime as dt
import random

import pytest
from loops import fill_series, fill_traffic

from zonecast import GridConfig
from zonecast.operators import fill

CFG = GridConfig(slot_seconds=3 * 3600, n_zones=6)
DAYS = [dt.date(2016, 1, d) for d in (1, 2, 9, 20)]
TRAFFIC = "date date, slot int, zone int, t1 int, t2 int, t3 int, t4 int"


def sparse(seed):
    """Cells of four days; the third day is empty, zones 1, 3 and 4 of the second are."""
    rng = random.Random(seed)
    cells = {}
    for day in DAYS:
        for z in range(1, 7):
            if day == DAYS[2] or (day == DAYS[1] and z in (1, 3, 4)):
                continue
            for s in range(1, 9):
                if rng.random() < 0.25:
                    cells[day, s, z] = tuple(rng.randint(1, 99) for _ in range(4))
    return cells


def days_df(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "date date")


@pytest.mark.parametrize("seed", [1, 2])
def test_traffic(spark, seed):
    cells = sparse(seed)
    obs = spark.createDataFrame([(*k, *v) for k, v in cells.items()], TRAFFIC)
    got = {
        (r.date, r.slot, r.zone): (r.t1, r.t2, r.t3, r.t4)
        for r in fill.fill_traffic(days_df(spark), obs, CFG).collect()
    }
    want = {}
    for day in DAYS:
        mine = {(s, z): v for (d, s, z), v in cells.items() if d == day}
        want |= {(day, *k): v for k, v in fill_traffic(8, 6, mine, (0, 0, 0, 0)).items()}
    assert got == want


@pytest.mark.parametrize("seed", [5])
def test_traffic_with_source_keys(spark, seed):
    cells = sparse(seed)
    obs = spark.createDataFrame([(*k, *v) for k, v in cells.items()], TRAFFIC)
    filled = fill.fill_traffic(days_df(spark), obs, CFG, stale_keys=True)
    got = {(r.date, r.slot, r.zone): tuple(r)[3:] for r in filled.collect()}
    want = {}
    for day in DAYS:
        mine = {(s, z): (day.day % 7, z, s, *v) for (d, s, z), v in cells.items() if d == day}
        want |= {(day, *k): v for k, v in fill_traffic(8, 6, mine, (0,) * 7).items()}
    assert filled.columns[3:6] == ["src_day", "src_zone", "src_slot"]
    assert got == want


def test_traffic_without_carry(spark):
    obs = spark.createDataFrame([(DAYS[0], 2, 2, 1, 2, 3, 4)], TRAFFIC)
    rows = fill.fill_traffic(days_df(spark), obs, CFG, leak_carry=False).where("t1 <> 0").collect()
    assert {(r.date, r.zone) for r in rows} == {(DAYS[0], 2)} and len(rows) == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_weather(spark, seed):
    rng = random.Random(seed)
    seen = {
        d: {s: (s, s * 1.5, s * 2.5) for s in range(1, 9) if rng.random() < 0.3}
        for d in DAYS
        if d != DAYS[1]
    }
    rows = [(d, s, *v) for d, m in seen.items() for s, v in m.items()]
    obs = spark.createDataFrame(
        rows, "date date, slot int, weather int, temp double, pollution double"
    )
    got = {(r.date, r.slot): tuple(r)[2:] for r in fill.fill_weather(days_df(spark), obs, CFG).collect()}
    want = {}
    for d in DAYS:
        filled, _ = fill_series(8, seen.get(d, {}), (0, 0.0, 0.0))
        want |= {(d, s): v for s, v in filled.items()}
    assert got == want
    grid = {(r.date, r.slot): r.weather for r in fill.weather_grid(days_df(spark), obs, CFG).collect()}
    assert grid == {(d, s): seen.get(d, {}).get(s, (None,))[0] for d in DAYS for s in range(1, 9)}
