from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from world import CFG, DAYS, World

from zonecast.config import GAP_COLUMNS, LEVELS, TRAFFIC_COLUMNS
from zonecast.operators import gaps, poi
from zonecast.plans import features as pf
from zonecast.plans.clean import RawPaths, clean
from zonecast.sources import readers


class Built:
    """The sparse tables, made by the library from the files of the tiny city."""

    def __init__(self, spark, folder):
        self.world = World()
        paths = self.world.write(folder)
        self.orders = readers.read_orders(spark, paths["orders"])
        names = ("orders", "traffic", "weather", "zones", "poi")
        cleaned, self.audit = clean(spark, RawPaths(*(paths[n] for n in names)), CFG)
        self.days, self.gaps = cleaned.days, cleaned.gaps
        self.traffic, self.weather, self.pivot = cleaned.traffic, cleaned.weather, cleaned.poi
        self.raw_pivot = clean(spark, RawPaths(*(paths[n] for n in names)), CFG, scaled_poi=False)[0].poi

    def args(self, scaled=True):
        return self.traffic, self.weather, self.pivot if scaled else self.raw_pivot, CFG


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return Built(spark, tmp_path_factory.mktemp("city"))


def close(got, want):
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k] == pytest.approx(row, rel=1e-12, nan_ok=True) if None not in row else True
        for a, b in zip(got[k], row, strict=True):
            assert (a is None) == (b is None), (k, got[k], row)
            assert b is None or a == pytest.approx(b, rel=1e-12)


def matrix_of(df):
    assert df.columns == ["date", *GAP_COLUMNS]
    return {(r["date"], r["id"]): tuple(r)[2:] for r in df.collect()}


def test_inputs(built):
    cells = {(r.date, r.slot, r.zone): tuple(r)[3:] for r in built.traffic.collect()}
    assert cells == built.world.traffic_cells()
    seen = {(r.date, r.slot): tuple(r)[2:] for r in built.weather.collect()}
    assert seen == built.world.weather_cells()
    counts = {(r.date, r.slot, r.origin, r.dest): r.gap for r in built.gaps.collect()}
    assert counts == dict(built.world.gap_counts())
    served = {r.date: r.served for r in gaps.served_total(built.orders).collect()}
    assert sum(served.values()) + sum(counts.values()) == len(built.world.orders)


def test_raw_matrix(built):
    df = pf.features_raw(built.days, built.gaps, *built.args(scaled=False))
    close(matrix_of(df), built.world.gap_matrix("raw"))


def test_rescaled_matrix(built):
    df = pf.features_norm(built.days, built.gaps, *built.args())
    got = matrix_of(df)
    assert len(got) == len(DAYS) * CFG.n_slots * CFG.n_zones * (CFG.n_zones + 1)
    close(got, built.world.gap_matrix("norm"))


def test_test_matrix(spark, built):
    scored = {}
    for k, (day, s, z) in enumerate((d, s, z) for d in DAYS for s in (1, 2, 4) for z in (1, 3, 4)):
        seen = tuple(None if (k + i) % 3 else 0.1 * i for i in range(4))
        scored[day, s, z] = (seen, (1.0, 2.0, 3.0, 4.0 + k))
    schema = "date date, slot int, zone int, " + ", ".join(
        f"{t}{p} double" for p in ("", "p") for t in LEVELS
    )
    levels = spark.createDataFrame([(*k, *a, *b) for k, (a, b) in scored.items()], schema)
    _, weather, pivot, cfg = built.args()
    df = pf.features_test(built.days, built.gaps, levels, weather, pivot, cfg)
    close(matrix_of(df), built.world.gap_matrix("test", scored))


def traffic_rows(world, cells, stale=None):
    """Loop form of the traffic tables; ``stale`` maps a cell to the key of its source row."""
    weather, pois = world.weather_filled(False), world.poi(False)
    out = []
    for (day, s, z), levels in cells.items():
        key = stale[day, s, z] if stale else (day.day % 7, z, s)
        none = (None,) * len(TRAFFIC_COLUMNS[9:])
        out.append((day, *key, *levels, *weather[day, s][1:], *pois.get(z, none)))
    return out


def same_rows(df, want):
    assert df.columns == ["date", *TRAFFIC_COLUMNS]

    def key(r):
        return tuple(-1.0 if v is None else v for v in r)

    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0]
        for x, y in zip(a[1:], b[1:], strict=True):
            assert (x is None) == (y is None) and (y is None or x == pytest.approx(y, rel=1e-12))


def test_traffic_tables(built):
    from loops import fill_traffic

    world, seen = built.world, built.world.traffic_cells()
    grid = [(d, s, z) for d in DAYS for s in range(1, 5) for z in range(1, 5)]
    scaled = {k: world.scaled(v) for k, v in seen.items()}
    same_rows(pf.traffic_observed(built.days, *built.args()), traffic_rows(world, scaled))
    sparse = {k: scaled.get(k, (None,) * 4) for k in grid}
    same_rows(pf.traffic_predict_grid(built.days, *built.args()), traffic_rows(world, sparse))

    filled, source = {}, {}
    for day in DAYS:
        keyed = {(s, z): (day.day % 7, z, s, *v) for (d, s, z), v in seen.items() if d == day}
        for (s, z), v in fill_traffic(4, 4, keyed, (0,) * 7).items():
            filled[day, s, z], source[day, s, z] = world.scaled(v[3:]), v[:3]
    same_rows(pf.traffic_train(built.days, *built.args()), traffic_rows(world, filled))
    same_rows(
        pf.traffic_train(built.days, *built.args(), stale_keys=True),
        traffic_rows(world, filled, source),
    )


def test_weather_table(built):
    got = {(r.date, r.timeslice): tuple(r)[3:] for r in pf.weather_table(built.days, built.weather, CFG).collect()}
    seen = built.world.weather_cells()
    assert got == {(d, s): seen.get((d, s), (None,) * 3) for d in DAYS for s in range(1, 5)}


def test_unknown_origin_fails_or_is_rejected(spark, built):
    zones = spark.createDataFrame([("h1", 1)], "zone_hash string, zone_id int")
    with pytest.raises(Exception, match="unknown zone hash"):
        gaps.gap_counts(built.orders, zones).collect()
    lenient = gaps.gap_counts(built.orders, zones, strict=False)
    assert {r.origin for r in lenient.collect()} == {1}
