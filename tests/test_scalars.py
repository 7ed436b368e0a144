from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from zonecast.functions import scalars as sc


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "time, slot",
    [
        ("00:02:30", 1), ("00:12:30", 2), ("00:00:00", 1), ("00:09:59", 1),
        ("00:10:00", 2), ("23:49:59", 143), ("23:50:00", 144), ("23:59:59", 144),
    ],
)
def test_slot(spark, time, slot):
    ts = F.lit(f"2016-01-01 {time}").cast("timestamp_ntz")
    assert one(spark, sc.slot_of_day(ts)) == slot


def test_index(spark):
    assert one(spark, sc.od_encode(F.lit(1), F.lit(1), F.lit(1))) == 10101
    assert one(spark, sc.od_encode(F.lit(144), F.lit(66), F.lit(66))) == 1446666
    assert tuple(one(spark, sc.od_decode(F.lit(10101)))) == (1, 1, 1)
    assert tuple(one(spark, sc.od_decode(F.lit(1446666)))) == (144, 66, 66)


def test_index_round_trip_over_the_whole_grid(spark):
    grid = spark.sql(
        "SELECT * FROM (SELECT explode(sequence(1, 144)) t), (SELECT explode(sequence(1, 66)) s), "
        "(SELECT explode(sequence(0, 66)) d)"
    )
    k = sc.od_decode(sc.od_encode("t", "s", "d"))
    bad = grid.withColumn("k", k).where("k.slot <> t OR k.origin <> s OR k.dest <> d")
    assert bad.count() == 0


def test_level_tokens(spark):
    assert one(spark, sc.parse_level(F.lit("1:231"))) == 231
    assert one(spark, sc.parse_level(F.lit("x"), strict=False)) is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|CAST_INVALID_INPUT"):
        one(spark, sc.parse_level(F.lit("x")))


def test_conditionals(spark):
    null = F.lit(None).cast("double")
    assert one(spark, sc.cut_small(F.lit(0.49))) == 0.0
    assert one(spark, sc.cut_small(F.lit(0.5))) == 0.5
    assert one(spark, sc.cut_small(null)) is None
    assert one(spark, sc.clamp_temp(F.lit(-3.0))) == 0.0
    assert one(spark, sc.clamp_temp(F.lit(3.0))) == 3.0
    assert one(spark, sc.clamp_temp(null)) is None
    assert one(spark, sc.observed_or(null, F.lit(2.0))) == 0.5
    assert one(spark, sc.observed_or(F.lit(0.3), F.lit(2.0))) == 0.3
    assert one(spark, sc.scaled_temperature(F.lit(-20.0))) == 0.0
    assert one(spark, sc.scaled_pollution(F.lit(177.0))) == 1.77


def test_labels(spark):
    date = F.lit("2016-01-22").cast("date")
    assert one(spark, sc.slot_label(date, F.lit(7))) == "2016-01-22_7"
    assert one(spark, sc.label_from_name(F.lit("final_day_2016-01-24_test.csv"))) == "2016-01-24_"
    assert one(spark, sc.day_label(F.lit(3))) == "03"
    assert one(spark, sc.day_mod7(date)) == 1
