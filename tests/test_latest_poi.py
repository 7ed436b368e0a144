from __future__ import annotations

import datetime as dt

import pytest
from loops import poi_totals

from zonecast.config import POI_COLUMNS, POI_DIVISORS
from zonecast.operators import dims, latest, poi

T0 = dt.datetime(2016, 1, 1, 0, 0, 0)


def test_last_wins_by_time_then_id(spark):
    us = dt.timedelta(microseconds=1)
    big = 1 << 40
    rows = [
        # (key, time, id, value): time decides first, then the id, also above 33 bits
        (1, T0 + 5 * us, 9, 10), (1, T0 + 6 * us, 1, 11),
        (2, T0, 3, 20), (2, T0, 4, 21), (2, T0, 2, 22),
        (3, T0 + 9 * us, big + 1, 30), (3, T0 + 9 * us, 7, 31), (3, T0 + 8 * us, big * 4, 32),
        (4, T0 + dt.timedelta(seconds=599, microseconds=999999), (1 << 33) - 1, 40), (4, T0, 1 << 50, 41),
        (5, T0, 0, None),
    ]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id bigint, v int")
    got = {r.k: r.v for r in latest.last_wins(df, ["k"], "ts", "id", ["v"]).collect()}
    assert got == {1: 11, 2: 21, 3: 30, 4: 40, 5: None}


def test_raw_rows_meet_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, T0, 1, 1)], "k int, ts timestamp_ntz, id bigint, v int")
    plan = latest.last_wins(df, ["k"], "ts", "id", ["v"])._jdf.queryExecution().executedPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest and "partial_max_by" in lowest


def test_zone_map_and_rejects(spark):
    rows = [("a", 5, 1), ("b", 2, 2), ("a", 3, 3), ("c", 67, 1), ("c", 4, 2)]
    zones = spark.createDataFrame(rows, "zone_hash string, zone_id int, row_pos int")
    dim = dims.zone_map(zones).where("zone_hash <> 'c'")
    assert {tuple(r) for r in dim.collect()} == {("a", 3), ("b", 2)}
    with pytest.raises(Exception, match="zone id out of range: 67"):
        dims.zone_map(zones.where("row_pos = 1")).collect()
    df = spark.createDataFrame([("a",), ("x",), (None,)], "h string")
    known, rejects = dims.split_known(df, dim, "h")
    assert [r.h for r in known.collect()] == ["a"]
    assert {r.h for r in rejects.collect()} == {"x", None}
    back = dims.attach_zone(df, dim, "h", "z", default=0)
    assert sorted(r.z for r in back.collect()) == [0, 0, 3]
    assert [r.z for r in dims.attach_zone(df, dim, "h", "z", strict=False).collect()] == [3]
    with pytest.raises(Exception, match="unknown zone hash: x"):
        dims.attach_zone(df.where("h IS NOT NULL"), dim, "h", "z").collect()


def test_dimension_is_hinted_only_when_small(spark):
    dim = spark.range(50).selectExpr("cast(id as string) zone_hash", "cast(id as int) zone_id")
    hinted = dims.broadcast_if_small(dim, 50)._jdf.queryExecution().logical().toString()
    plain = dims.broadcast_if_small(dim, 49)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


LINES = {
    # blank tokens, category 9, subs above 20, a repeated key, keys of no known form
    "h1": ["1#2:10", "", "4:7", "19#1:3", "9:5", "9#3:6", "1#21:100", "1#20:2", "1:4", "1#2:11"],
    "h2": ["26:4", "01:9", "1#0:8", "25#5:6", "7:1", "7:2"],
    "h3": [],
}


def test_poi(spark, tmp_path):
    path = tmp_path / "poi.tsv"
    first = "h1\t2:1000\n"  # an earlier row of h1: replaced as a whole
    path.write_text(first + "".join("\t".join([h, *t]) + "\n" for h, t in LINES.items()))
    from zonecast.sources.readers import read_poi

    tokens = poi.last_rows(poi.explode_tokens(read_poi(spark, str(path))))
    parsed = poi.parse_poi(tokens, ["zone_hash"]).withColumnRenamed("zone_hash", "zone")
    for scaled in (False, True):
        got = {}
        for r in poi.poi_rollup(parsed, scaled=scaled).collect():
            got.setdefault(r.zone, {})[r.cat] = r.n
        assert got == {h: poi_totals(t, POI_DIVISORS if scaled else None) for h, t in LINES.items()}
    wide = poi.poi_pivot(parsed, scaled=False)
    assert wide.columns == ["zone", *POI_COLUMNS] and "9" not in wide.columns
    assert wide.where("zone = 'h1'").first()["1"] == 17
