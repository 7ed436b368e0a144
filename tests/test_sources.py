from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from world import DAYS, World

from zonecast.functions.scalars import is_unserved
from zonecast.operators import dims, latest, poi, quality, split
from zonecast.operators.forecasts import first_rows, forecast_rollup, mean_abs_error, merge_forecasts
from zonecast.session import new_path, stage
from zonecast.sources import readers, schemas, writers


def test_orders_keep_the_null_text_and_the_file_day(spark, tmp_path):
    world = World()
    paths = world.write(tmp_path)
    orders = readers.read_orders(spark, paths["orders"], file_day=True)
    assert orders.where(is_unserved("driver_id")).count() == sum(o[1] == "NULL" for o in world.orders)
    assert orders.where("date <> to_date(ts)").count() == 0
    picked = readers.select_days(orders, [DAYS[1]])
    assert {r.date for r in picked.select("date").distinct().collect()} == {DAYS[1]}
    files = [f"{paths['orders']}/orders_data_{d}" for d in DAYS[:2]]
    assert readers.read_orders(spark, files).count() == 120


def test_file_order_is_kept_over_files(spark, tmp_path):
    """The later file by name wins although Spark may read the larger one first."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1").write_text("h1\t1\n" + "h2\t2\n" * 500)
    (tmp_path / "a" / "2").write_text("h1\t9\n")
    zones = readers.read_zones(spark, str(tmp_path / "a"))
    assert {(r.zone_hash, r.zone_id) for r in dims.zone_map(zones).collect()} == {("h1", 9), ("h2", 2)}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a_first").write_text("h1\t1:5\n")
    (tmp_path / "p" / "b_second").write_text("h1\t1:9\n" + "h2\t2:1\n" * 500)
    tokens = poi.last_rows(poi.explode_tokens(readers.read_poi(spark, str(tmp_path / "p"))))
    assert {r.token for r in tokens.where("zone_hash = 'h1'").collect()} == {"1:9"}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1").write_text("2016-01-01 00:00:28\t1\t4.0\t1.0\n" + "2016-01-02 00:00:28\t1\t4.0\t1.0\n" * 300)
    (tmp_path / "w" / "2").write_text("2016-01-01 00:00:28\t7\t4.0\t1.0\n\t\t\t\n")
    weather = readers.read_weather(spark, str(tmp_path / "w"), row_pos=True)
    assert weather.count() == 302
    last = latest.latest_weather(weather, row_id="row_pos").where("date = '2016-01-01'").collect()
    assert [r.weather for r in last] == [7]


def test_bad_rows_fail(spark, tmp_path):
    (tmp_path / "w").write_text("2016-01-01 00:00:28\tsunny\t4.0\t177.0\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_weather(spark, str(tmp_path / "w")).collect()


def test_built_in_zones(spark):
    rows = readers.zone_dim(spark).collect()
    assert len(rows) == 66 == len({r.zone_hash for r in rows})
    assert sorted(r.zone_id for r in rows) == list(range(1, 67))
    known = {r.zone_hash: r.zone_id for r in rows}
    assert known["90c5a34f06ac86aee0fd70e2adce7d8a"] == 1
    assert known["1ecbb52d73c522f184a6fc53128b1ea1"] == 66


def forecast(spark):
    rows = [(dt.date(2016, 1, d), s, z, s, s / 3.0) for d in (22, 24) for s in (1, 2) for z in (1, 2)]
    return spark.createDataFrame(
        rows, "date date, timeslice int, districtID int, gap bigint, predict double"
    )


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_daily_tables(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    df = forecast(spark)
    cols = ["date", *schemas.FORECAST.names]
    writers.write_daily(df.select(*cols), path, fmt)
    back = readers.read_forecast(spark, path, fmt).select(*cols)
    assert sorted(back.collect()) == sorted(df.select(*cols).collect())
    one_day = readers.select_days(back, [dt.date(2016, 1, 24)])
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert one_day.count() == 4 and "PartitionFilters: [isnotnull(date" in plan


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_day_is_written_anew_and_the_others_stay(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    cols = ["date", *schemas.FORECAST.names]
    df = forecast(spark).select(*cols)
    days = [df.where(F.dayofmonth("date") == d) for d in (22, 24)]
    for day in days:
        writers.write_daily(day, path, fmt)
    writers.write_daily(days[0].withColumn("gap", F.col("gap") + 10), path, fmt)
    back = readers.read_forecast(spark, path, fmt)
    assert sorted(r.gap for r in back.collect()) == [1, 1, 2, 2, 11, 11, 12, 12]
    # A write that fails leaves the old days.
    bad = days[1].withColumn("gap", F.when(F.col("districtID") == 2, F.raise_error("broken").cast("bigint")).otherwise(0))
    with pytest.raises(Exception, match="broken"):
        writers.write_daily(bad, path, fmt)
    assert sorted(r.gap for r in back.collect()) == [1, 1, 2, 2, 11, 11, 12, 12]


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    """Two folders with files of the same name: rows are placed by folder, then by line."""
    for folder in ("b", "a"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.tsv").write_text("".join(f"{folder}{k}\t{k + 1}\n" for k in range(3)))
    zones = readers.read_zones(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert [r.zone_hash for r in zones.orderBy("row_pos").collect()] == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_rejects_are_written_beside_known_rows(spark):
    """Counts add up, reasons are given, and the input is scanned once."""
    rows = [(k, None if k % 7 == 0 else f"h{k % 5}") for k in range(70)]
    df = stage(spark.createDataFrame(rows, "k int, zone_hash string"), "rows")
    zones = spark.createDataFrame([(f"h{z}", z + 1) for z in range(3)], "zone_hash string, zone_id int")
    path = new_path(spark, "known")
    known, rejected = dims.known_and_rejected(df, F.broadcast(zones), "zone_hash", "zone", path)
    assert known.columns == ["k", "zone"] and rejected.columns == ["k", "zone_hash", "reason"]
    assert known.count() + rejected.count() == 70
    assert {(r.k, r.zone) for r in known.collect()} == {(k, int(h[1]) + 1) for k, h in rows if h and int(h[1]) < 3}
    assert {r.reason for r in rejected.collect()} == {"no zone hash", "unknown zone hash"}
    text = known._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "PartitionFilters: [isnotnull(kind" in text


def test_csv_with_other_columns_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_daily(forecast(spark).select("date", "districtID", "timeslice", "gap", "predict"), path, "csv")
    with pytest.raises(Exception, match="header"):
        readers.read_forecast(spark, path).collect()


def test_merged_table(spark, tmp_path):
    path = str(tmp_path / "m")
    writers.write_merged(forecast(spark), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["timeslice", "districtID", "gap", "predict"]
    labels = {r.timeslice for r in merge_forecasts(forecast(spark)).collect()}
    assert labels == {r.timeslice for r in back.collect()} == {
        "2016-01-22_1", "2016-01-22_2", "2016-01-24_1", "2016-01-24_2"
    }


def test_rollup_and_error(spark):
    rows = [(1, 1, 1, 0, 1, 0.4), (1, 1, 1, 1, 2, 0.6), (1, 1, 2, 0, 0, None), (1, 2, 1, 0, 3, 5.0)]
    cells = spark.createDataFrame(
        rows, "date int, timeslice int, districtID int, dest int, gap int, predict double"
    )
    got = {tuple(r)[1:3]: tuple(r)[3:] for r in forecast_rollup(cells).collect()}
    assert got == {(1, 1): (3, 0.6), (1, 2): (0, None), (2, 1): (3, 5.0)}
    plain = forecast_rollup(cells, cut=None)
    assert mean_abs_error(plain.where("predict IS NOT NULL")).first().mae == pytest.approx(2.0)
    assert [tuple(r)[:3] for r in first_rows(plain, 2).collect()] == [(1, 1, 1), (1, 1, 2)]


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (None, None), (0, "x")], "a int, b string")
    assert quality.drop_all_null(df).count() == 2
    assert tuple(quality.audit_slots(df, "a", 144).first()) == (3, 1)
    counts = {r.stage: r.n_rows for r in quality.count_stages(all=df, some=df.where("a = 1")).collect()}
    assert counts == {"all": 3, "some": 1}
    const = df.withColumns({"c": F.lit(1), "d": F.lit(None)})
    assert quality.drop_constant(const, ["a", "c", "d"]).columns == ["a", "b"]
    watched, obs = quality.observed(df, "rows")
    watched.collect()
    assert obs.get["n_rows"] == 3


def test_splits(spark):
    """The 80/20 split on OD ids is one of rows: every slot, origin and pair lies on both sides."""
    df = spark.sql(
        "SELECT date, slot, o, d, slot * 10000 + o * 100 + d AS id FROM "
        "(SELECT explode(sequence(DATE'2016-01-01', DATE'2016-01-09')) AS date), "
        "(SELECT explode(sequence(1, 12)) AS slot), (SELECT explode(sequence(1, 9)) AS o), (SELECT explode(sequence(0, 9)) AS d)"
    )
    train, test = split.hash_split(df, "id")
    assert train.intersect(test).count() == 0 and train.count() + test.count() == df.count()
    marked = df.withColumn("train", split.in_train("id", "date").cast("double"))
    for by, low, high in ((["slot"], 0.7, 0.9), (["o"], 0.7, 0.9), (["date"], 0.7, 0.9), (["o", "d"], 0.5, 0.99)):
        shares = marked.groupBy(*by).agg(F.avg("train").alias("s")).agg(F.min("s"), F.max("s")).first()
        assert low < shares[0] and shares[1] < high, (by, shares)
    df = spark.range(5000)
    a, b = split.random_split(df)
    assert a.count() + b.count() == 5000
