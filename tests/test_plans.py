"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import SF

from pyspark.sql import functions as F

from zonecast.fixtures import Inputs
from zonecast.operators import fill, gaps, grids, poi, series
from zonecast.plans import features as pf


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def matrix(i):
    return pf.features_norm(i.days, i.gaps, i.traffic, i.weather, poi.poi_pivot(i.poi))


def test_zone_lookups_are_broadcast_and_counts_combine_early(inputs):
    text = plan(inputs.gaps)
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    assert "partial_count" in text
    fact = [line for line in text.splitlines() if "FileScan" in line and "event_type" in line]
    assert len(fact) == 1 and "value" not in re.search(r"ReadSchema.*", fact[0])[0]


def test_served_orders_go_before_the_second_lookup(inputs):
    """The driver is looked at once the origin is known, below the destination's lookup and the count."""
    lines = plan(inputs.gaps).splitlines()
    at = lambda what: [k for k, line in enumerate(lines) if what in line]
    filters = [k for k in at("Filter") if "raise_error" in lines[k]]
    joins = at("BroadcastHashJoin")
    assert len(filters) == 1 and joins[0] < filters[0] < joins[1]
    assert max(at("partial_count")) < filters[0]


def test_a_served_order_of_an_unknown_origin_fails(spark):
    zones = spark.createDataFrame([("a", 1), ("b", 2)], "zone_hash string, zone_id int")
    kind = "driver_id string, start_hash string, dest_hash string, ts timestamp"
    good = [("NULL", "a", "b", None), ("d1", "b", "x", None), ("NULL", "b", "x", None)]
    ts = F.to_timestamp(F.lit("2024-01-01 10:00:00"))
    count = lambda rows, **how: gaps.gap_counts(
        spark.createDataFrame(rows, kind).withColumn("ts", ts), zones, **how
    ).collect()
    assert sorted((r.origin, r.dest, r.gap) for r in count(good)) == [(1, 2, 1), (2, 0, 1)]
    with pytest.raises(Exception, match="unknown zone hash: z"):
        count([*good, ("d2", "z", "a", None)])
    assert len(count([*good, ("d2", "z", "a", None)], strict=False)) == 2


def scans(text: str) -> Counter:
    found = re.findall(r"FileScan parquet \[(.*?)\]", text)
    return Counter(re.sub(r"#\d+L?", "", columns) for columns in found)


def test_raw_rows_are_read_once_per_input(inputs):
    """Each reader of the event table takes its own columns, and takes them once."""
    read = scans(plan(matrix(inputs)))
    assert read["event_id,ts,user_id,event_type"] == 1  # orders
    assert read["event_id,ts,user_id,value"] == 1  # traffic
    assert read["event_id,ts,value"] == 1  # weather
    assert read["p_partkey,p_brand,p_size,p_retailprice"] == 1  # points of interest


def test_matrix_is_not_shuffled_after_the_explode(inputs):
    """Destinations appear last: nothing above the top Generate but a projection."""
    lines = [line for line in plan(matrix(inputs)).splitlines() if line.strip()]
    top = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange" in line or "Join" in line or "Sort" in line for line in lines[:top])


@pytest.mark.parametrize("make", [matrix, lambda i: fill.fill_traffic(i.days, i.traffic)])
def test_no_cartesian_product_and_no_python(inputs, make):
    text = plan(make(inputs))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert word not in text


def test_od_grid_has_the_given_parallelism(spark, inputs):
    grid = grids.od_grid(inputs.days)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grid.rdd.getNumPartitions() == n


def test_series_windows_are_cut_into_blocks(inputs):
    text = plan(series.lag_matrix(inputs.view("daily_series"), "key", "t", ["y"], 1))
    windows = [line for line in text.splitlines() if re.search(r"\bWindow\b", line)]
    assert windows
    # windows over rows carry a block or a partition; those over the key alone run on one row per partition
    assert any("_block" in w for w in windows) and any("_part" in w for w in windows)


def test_regression_solves_one_triangle_per_key(inputs):
    text = plan(series.granger(inputs.view("daily_series"), "key", "t", "x", "y", 1))
    # the solution of one triangle, over the merge of a key's triangles, over their grouping
    above = text.split("MapInPandas")[2].splitlines()[1]
    assert "HashAggregate" in above or "ObjectHashAggregate" in above
