from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from zonecast.catalog import model_queries
from zonecast.operators.split import day_split
from zonecast.config import GAP_COLUMNS, LEVELS, POI_COLUMNS, TEST_DAYS, TRAIN_DAYS, GridConfig
from zonecast.models import net, packed, trees
from zonecast.operators.forecasts import forecast_rollup
from zonecast.operators.prepare import impute_mean
from zonecast.plans import features as pf
from zonecast.plans import forecast as jobs
from zonecast.plans.stages import Stages
from zonecast.session import new_path, stage
from zonecast.sources.writers import load_model, model_params, save_model

CFG = GridConfig(slot_seconds=6 * 3600, n_zones=8)


@pytest.fixture(scope="module")
def inputs(spark):
    """A smooth demand over 26 days, 4 slots and 8 zones; zone 8 has no POI."""
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-26')) AS date")
    cells = days.selectExpr("date", "explode(sequence(1, 4)) AS slot").selectExpr(
        "*", "explode(sequence(1, 8)) AS zone"
    )
    dests = cells.selectExpr("date", "slot", "zone AS origin", "explode(sequence(0, 8)) AS dest")
    gaps = dests.withColumn("gap", F.expr("slot * (origin % 3) + dest % 2").cast("bigint")).where("gap > 0")
    level = F.col("slot") * 10 + F.col("zone")
    traffic = cells.where("(slot + zone) % 3 > 0").select(
        "date", "slot", "zone", *[(level * k).cast("int").alias(f"t{k}") for k in (1, 2, 3, 4)]
    )
    weather = days.selectExpr("date", "explode(sequence(1, 4)) AS slot").selectExpr(
        "date", "slot", "(slot + day(date)) % 3 + 1 AS weather", "slot * 2.0D AS temp", "slot * 9.0D AS pollution"
    )
    poi = spark.range(1, 8).select(
        F.col("id").cast("int").alias("zone"),
        *[(F.col("id") * int(c) / 10.0).alias(c) for c in POI_COLUMNS],
    )
    return jobs.Cleaned(days, gaps, traffic, weather, poi)


@pytest.fixture(scope="module")
def tables(spark, inputs):
    m = pf.features_norm(inputs.days, inputs.gaps, inputs.traffic, inputs.weather, inputs.poi, CFG)
    m = stage(m, "gap_features")
    return day_split(m, TRAIN_DAYS, TEST_DAYS)


def mae(df):
    return df.agg(F.avg(F.abs(F.col("predict") - F.col("gap")))).first()[0]


def baseline(train, test):
    mean = train.agg(F.avg("gap")).first()[0]
    return mae(test.withColumn("predict", F.lit(mean)))


SMALL = dict(trees=4, depth=6)


def test_forest_beats_the_mean_and_repeats(tables):
    train, test = tables
    preset = replace(trees.FOREST["full"], **SMALL)
    scored = trees.score(trees.fit_forest(train, preset), test)
    assert scored.columns == [*test.columns, "predict"]
    assert scored.count() == test.count()
    assert mae(scored) < 0.5 * baseline(train, test)
    again = trees.score(trees.fit_forest(train, preset), test)
    keys = ["date", "id", "predict"]
    assert sorted(again.select(*keys).collect()) == sorted(scored.select(*keys).collect())


def test_presets_leave_columns_out(tables):
    cats, nums = trees.feature_columns(trees.FOREST["short"], GAP_COLUMNS)
    assert cats == ["timeslice", "districtID", "destDistrict"]
    assert nums == ["traffic1", "traffic2", "traffic3", "traffic4", "pollution", *POI_COLUMNS]
    cats, _ = trees.feature_columns(trees.FOREST["full"], GAP_COLUMNS)
    assert cats == ["timeslice", "districtID", "destDistrict", "day"]


def test_boosted(tables):
    train, test = tables
    model = trees.fit_boosted(train, replace(trees.BOOSTED["raw"], trees=6, depth=4))
    assert mae(trees.score(model, test)) < baseline(train, test)
    rounds = [r.value for r in trees.validate(model, test).orderBy("trees").collect()]
    assert len(rounds) == 6 and rounds[-1] < rounds[0]


def test_saved_model_gives_the_same_forecast(spark, tables):
    train, test = tables
    model = trees.fit_forest(train, replace(trees.FOREST["short"], **SMALL))
    path = new_path(spark, "model")
    save_model(model, path)
    keys = ["date", "id", "predict"]
    before = trees.score(model, test).select(*keys)
    after = trees.score(load_model(path), test).select(*keys)
    assert sorted(before.collect()) == sorted(after.collect())
    assert model_params(load_model(path))["maxDepth"] == "6"


def test_net(tables, spark):
    """Better than the mean, saved and loaded with its pipeline, and read back parameter by parameter."""
    train, test = tables
    model = net.fit_net(train, "full", hidden=(16, 16), epochs=3)
    scored = trees.score(model, test)
    assert scored.columns == [*test.columns, "predict"] and scored.count() == test.count()
    assert mae(scored) < baseline(train, test)
    path = new_path(spark, "net")
    save_model(model, path)
    loaded = load_model(path)
    keys = ["date", "id", "predict"]
    assert sorted(scored.select(keys).collect()) == sorted(trees.score(loaded, test).select(keys).collect())
    assert jobs.rescore(path, test).count() == forecast_rollup(scored).count()
    before, after = model_params(model), model_params(loaded)
    assert before == after and {"hidden", "levels", "numbers", "weights", "seed", "predictionCol"} <= set(before)


def test_net_does_not_depend_on_the_layout(tables):
    """Equal weights for two and for eight partitions of the training rows."""
    train, _ = tables
    found = [net.fit_net(train.repartition(n), "full", hidden=(8,), epochs=2, replicas=4).stages[-1] for n in (2, 8)]
    weights = [np.array(m.getOrDefault(m.weights)) for m in found]
    assert np.allclose(weights[0], weights[1], rtol=1e-6, atol=1e-9)


def test_net_errors_by_epoch(tables):
    """The last line is the error of the model; accumulators go on, so two epochs are not one epoch twice."""
    train, test = tables
    model, errors = net.errors_by_epoch(train, test, "full", hidden=(8,), epochs=3)
    lines = {(r.epoch, r.metric): r.value for r in errors.collect()}
    assert len(lines) == 6
    scored = trees.score(model, test)
    for metric in ("mae", "rmse"):
        want = RegressionEvaluator(labelCol="gap", predictionCol="predict", metricName=metric).evaluate(scored)
        assert lines[3, metric] == pytest.approx(want, rel=1e-9)


def test_forest_errors_by_tree(tables):
    """One line a tree and metric; the last is the evaluator's, the first that of a forest of the first tree."""
    train, test = tables
    model = trees.fit_forest(train, replace(trees.FOREST["full"], trees=4, depth=4))
    lines = {(r.trees, r.metric): r.value for r in trees.validate(model, test).collect()}
    assert len(lines) == 8
    scored = trees.score(model, test)
    for metric in ("mae", "rmse"):
        want = RegressionEvaluator(labelCol="gap", predictionCol="predict", metricName=metric).evaluate(scored)
        assert lines[4, metric] == pytest.approx(want, rel=1e-9)


def _cells(spark, n_dests=5):
    rng, rows = np.random.default_rng(0), []
    for date in range(4):
        for slot in range(1, 13):
            for zone in range(1, 7):
                a, b = float(rng.integers(0, 6)), float(rng.integers(0, 4))
                gaps = {d: float(rng.normal() + (slot > 6) * d + a * (zone == 2)) for d in range(n_dests) if rng.random() < 0.7}
                rows.append((date, slot, zone, a, b, gaps))
    kind = "date int, timeslice int, districtID int, a double, b double, gaps map<int,double>"
    cells = stage(spark.createDataFrame(rows, kind).repartition(3), "cells")
    arrays = cells.withColumns({"dests": F.map_keys("gaps"), "gap": F.map_values("gaps")})
    keys = ("date", "timeslice", "districtID")
    return cells, packed.Packed(arrays, keys, ("timeslice", "districtID"), ("a", "b"), ("gap",), n_dests)


def test_packed_tree_is_the_tree_of_the_exploded_rows(spark):
    """One tree on all rows and features forecasts what Spark's own tree does."""
    cells, data = _cells(spark)
    model = packed.fit_packed(data, trees.Preset(trees=1, depth=5, drop_constant=False), sample=1.0, third=False)
    keys = ["date", "timeslice", "districtID"]
    mine = model.score(data, keys).select(*keys, F.posexplode("gap_predict").alias("dest", "mine"))
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dest"))
    rows = rows.withColumn("gap", F.coalesce(F.try_element_at("gaps", F.col("dest")), F.lit(0.0)))
    indexed = StringIndexer(inputCols=["timeslice", "districtID", "dest"], outputCols=["i0", "i1", "i2"]).fit(rows).transform(rows)
    ready = VectorAssembler(inputCols=["i0", "i1", "a", "b", "i2"], outputCol="features").transform(indexed)
    tree = RandomForestRegressor(
        numTrees=1, maxDepth=5, featureSubsetStrategy="all", bootstrap=False, subsamplingRate=1.0, labelCol="gap"
    ).fit(ready)
    both = tree.transform(ready).join(mine, [*keys, "dest"])
    assert both.count() == 1440 and both.where("abs(mine - prediction) > 1e-9").isEmpty()


def test_packed_forest(spark):
    """Layout does not matter, NULL and unseen values have a place, errors run over the trees, saving keeps all."""
    cells, data = _cells(spark)
    preset = trees.Preset(trees=6, depth=6, seed=5, drop_constant=False)
    model = packed.fit_packed(data, preset)
    other = packed.fit_packed(replace(data, cells=data.cells.repartition(7)), preset)
    assert np.array_equal(model.trees.feature, other.trees.feature) and np.allclose(model.trees.value, other.trees.value)
    keys = ["date", "timeslice", "districtID"]
    odd = data.cells.withColumns({"timeslice": F.lit(99), "a": F.lit(None).cast("double"), "dests": F.lit(None).cast("array<int>")})
    strange = replace(data, cells=odd.withColumn("gap", F.lit(None).cast("array<double>")))
    assert model.score(strange, keys).where("exists(gap_predict, x -> x is null or isnan(x))").isEmpty()
    lines = {(r.trees, r.metric): r.value for r in model.errors_by_tree(data).collect()}
    assert len(lines) == 12 and lines[6, "rmse"] < lines[1, "rmse"]
    long = model.score(data, [*keys, "gaps"]).select("gaps", F.posexplode("gap_predict").alias("dest", "p"))
    off = F.col("p") - F.coalesce(F.try_element_at("gaps", F.col("dest")), F.lit(0.0))
    assert lines[6, "mae"] == pytest.approx(long.agg(F.avg(F.abs(off))).first()[0], rel=1e-9)
    path = new_path(spark, "packed")
    model.save(spark, path)
    loaded = packed.PackedForest.load(spark, path)
    assert sorted(map(str, loaded.score(data, keys).collect())) == sorted(map(str, model.score(data, keys).collect()))
    empty = replace(data, cells=data.cells.where("date > 100"))
    assert packed.fit_packed(empty, preset).score(data, keys).count() == cells.count()


def test_forests_finished_apart(spark, monkeypatch):
    """Small nodes that are finished in tasks of their own: whole trees, whatever the layout, saved and read again."""
    _, data = _cells(spark)
    # Whole numbers, whose sums do not depend on their order.
    data = replace(data, cells=data.cells.withColumn("gap", F.transform("gap", lambda x: F.round(x))))
    preset, keys = trees.Preset(trees=6, depth=9, seed=5, drop_constant=False), ["date", "timeslice", "districtID"]
    shown = lambda m: [r.gap_predict for r in m.score(data, keys).orderBy(*keys).collect()]
    errors = lambda m: {(r.trees, r.metric): r.value for r in m.errors_by_tree(data).collect()}
    every = packed.fit_packed(data, preset, sample=1.0, third=False)
    monkeypatch.setattr(packed, "FRONTIER", 10)
    monkeypatch.setattr(packed, "OWN_ROWS", 200)
    model = packed.fit_packed(data, preset, sample=1.0, third=False)
    assert every.lower is None and model.lower.count() > 6 and len(model.trees.feature) < len(every.trees.feature) / 2
    # All features at every split: the same trees however they are grown.
    assert np.allclose(shown(model), shown(every), rtol=1e-9, atol=1e-12)
    want = errors(every)
    assert len(want) == 12 and errors(model) == pytest.approx(want, rel=1e-9)
    some = packed.fit_packed(data, preset)
    other = packed.fit_packed(replace(data, cells=data.cells.repartition(7)), preset)
    assert np.allclose(shown(some), shown(other), rtol=1e-9, atol=1e-12)
    path = new_path(spark, "packed")
    some.save(spark, path)
    assert shown(packed.PackedForest.load(spark, path)) == shown(some)


def test_packed_sample_is_a_share(spark):
    """A tree learns from about the given share of the rows, and two trees from different ones."""
    _, data = _cells(spark, 67)
    bins = packed.make_bins(data, 20, False)
    batch = data.rows().toArrow().combine_chunks().to_batches()[0]
    block = packed.Block(batch, bins, [0, 1, 2, 3], 1)
    sets = [block.sampled(k, 3, 0.632) for k in (0, 1)]
    share = [np.bitwise_count(s).sum() / (67 * block.n) for s in (*sets, sets[0] & sets[1])]
    assert share[0] == pytest.approx(0.632, abs=0.02) and share[2] == pytest.approx(0.632**2, abs=0.02)


def test_net_gradient():
    import numpy as np

    shape = net.Shape((3, 2), 2, (4, 3))
    rng = np.random.default_rng(0)
    w = shape.start(1) + rng.normal(size=shape.start(1).size) * 0.1
    x, y = rng.normal(size=(5, 7)), rng.normal(size=5)

    def loss(v):
        return 0.5 * np.mean((shape.forward(shape.unpack(v), x)[-1][:, 0] - y) ** 2)

    g = shape.gradient(shape.unpack(w), x, y)
    for k in range(0, len(w), 5):
        e = np.zeros_like(w)
        e[k] = 1e-6
        assert g[k] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-6, abs=1e-6)


def test_traffic_levels(inputs):
    train = pf.traffic_train(inputs.days, inputs.traffic, inputs.weather, inputs.poi, CFG)
    grid = pf.traffic_predict_grid(inputs.days, inputs.traffic, inputs.weather, inputs.poi, CFG)
    scored = jobs.traffic_forecast(train, grid, replace(trees.FOREST["traffic"], trees=3, depth=5))
    assert scored.columns == ["date", "district", "timeslice", *LEVELS, *[f"{t}p" for t in LEVELS]]
    assert scored.count() == 26 * 4 * 8
    assert scored.where("t1 IS NULL").count() > 0 and scored.where("t1p IS NULL").count() == 0


def test_weather_code(inputs):
    grid = pf.weather_table(inputs.days, inputs.weather, CFG)
    scored = jobs.weather_forecast(grid, grid)
    assert scored.count() == 26 * 4
    assert {r.predict for r in scored.collect()} <= {1, 2, 3}


def test_short_raw_and_saved_jobs(spark, tables):
    train, test = tables
    both = train.unionByName(test)
    short = jobs.short_forecast(both, preset=replace(trees.FOREST["short"], **SMALL))
    assert short.forecast.count() == 4 * 8
    raw = jobs.raw_forecast(train, test, replace(trees.FOREST["raw"], **SMALL))
    assert {r.date.day for r in raw.validation.collect()} == {22, 24, 26}
    path = new_path(spark, "model")
    full = jobs.full_forecast(train, test, replace(trees.FOREST["full"], **SMALL), path)
    assert sorted(jobs.rescore(path, test).collect()) == sorted(full.forecast.collect())
    assert {r.metric for r in full.validation.collect()} == {"mae", "rmse"}


def test_end_to_end(spark, inputs):
    out = new_path(spark, "end_to_end")
    merged = jobs.end_to_end(
        inputs, TRAIN_DAYS, TEST_DAYS, out, CFG,
        replace(trees.FOREST["traffic"], trees=2, depth=4), replace(trees.FOREST["full"], **SMALL),
    )
    assert merged.columns == ["timeslice", "districtID", "gap", "predict"]
    assert merged.count() == 3 * 4 * 8
    back = spark.read.option("header", True).csv(f"{out}/merged")
    assert back.count() == merged.count()


def test_a_run_goes_on_where_it_ended(spark, inputs, monkeypatch):
    """Killed at its fourth step, the second call starts there; the third call does nothing; counts ride along."""
    out, made = new_path(spark, "run"), []
    small = replace(trees.FOREST["traffic"], trees=2, depth=3), replace(trees.FOREST["full"], trees=2, depth=4)

    def cleaned():
        made.append("inputs")
        return inputs

    def go():
        return jobs.end_to_end(cleaned, TRAIN_DAYS, TEST_DAYS, out, CFG, *small, packed=True)

    for name in ("traffic_train", "traffic_observed", "traffic_predict_grid", "features_norm", "features_test"):
        real = getattr(pf, name)
        monkeypatch.setattr(pf, name, lambda *a, real=real, name=name: made.append(name) or real(*a))
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "packed_traffic_forecast", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            go()
    assert made == ["inputs", "traffic_train", "traffic_observed", "traffic_predict_grid"]
    first = go()
    assert made[4:] == ["features_norm", "features_test"] and first.count() == 3 * 4 * 8
    again = go()
    assert len(made) == 6 and sorted(again.collect()) == sorted(first.collect())
    lines = {r.name: r for r in Stages(spark, out, "").audit().collect()}
    assert lines["traffic_predict"].n_rows == 3 * 4 * 8 and lines["traffic_predict"].first_day == "2024-01-22"
    assert lines["gap_train"].n_rows == 21 * 4 * 8 and {"forecast", "merged"} <= set(lines)
    # The cleaned tables are gone.
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{out}/cleaned_gaps")


def test_packed_jobs(spark, inputs):
    """Cells in, forecasts out: the validation has a line a tree, a saved forest forecasts the same."""
    cells = stage(pf.features_norm(inputs.days, inputs.gaps, inputs.traffic, inputs.weather, inputs.poi, CFG, packed=True), "cells")
    assert cells.count() == 26 * 4 * 8 and "destDistrict" not in cells.columns
    train, test = day_split(cells, TRAIN_DAYS, TEST_DAYS)
    preset, path = replace(trees.FOREST["full"], trees=5, depth=8), new_path(spark, "forest")
    full = jobs.packed_full_forecast(train, test, preset, path, CFG)
    shown = model_queries.beside_mean(full.forecast, train)
    error, mean_error = shown.agg(F.avg("error"), F.avg("mean_error")).first()
    assert shown.count() == 3 * 4 * 8 and error < mean_error
    assert {(r.trees, r.metric) for r in full.validation.collect()} == {(k, m) for k in range(1, 6) for m in ("mae", "rmse")}
    again = jobs.packed_rollup(packed.PackedForest.load(spark, path), test, preset, 0.5, CFG)
    assert sorted(again.collect()) == sorted(full.forecast.collect())
    raw = jobs.packed_raw_forecast(train, test, replace(preset, ignored=("id", "weather")), CFG)
    assert {r.date.day for r in raw.validation.collect()} == {22, 24, 26}
    # The errors of the mean agree with those of the exploded rows.
    dests = CFG.n_zones + 1
    lines = model_queries.packed_errors_beside_mean(full.validation, train, test, dests).collect()
    long = lambda c: c.select(F.explode(F.sequence(F.lit(0), F.lit(dests - 1))).alias("d"), "gaps").select(
        F.coalesce(F.try_element_at("gaps", F.col("d")), F.lit(0)).alias("gap")
    )
    mean = long(train).agg(F.avg("gap")).first()[0]
    off = F.col("gap") - mean
    mae, rmse = long(test).agg(F.avg(F.abs(off)), F.sqrt(F.avg(off * off))).first()
    assert all(r.mean_value == pytest.approx(mae if r.metric == "mae" else rmse, rel=1e-9) for r in lines)


def test_packed_traffic(spark, inputs):
    """All four levels at once; unobserved cells are forecast too, and their level stays NULL."""
    train = pf.traffic_train(inputs.days, inputs.traffic, inputs.weather, inputs.poi, CFG)
    grid = pf.traffic_predict_grid(inputs.days, inputs.traffic, inputs.weather, inputs.poi, CFG)
    scored = jobs.packed_traffic_forecast(train, grid, replace(trees.FOREST["traffic"], trees=8, depth=8))
    assert scored.columns == ["date", "district", "timeslice", *LEVELS, *[f"{t}p" for t in LEVELS]]
    assert scored.count() == 26 * 4 * 8 and 0 < scored.where("t1 is null").count() < 26 * 4 * 8
    seen = scored.where("t1 is not null")
    for t in LEVELS:
        error, spread = seen.agg(F.avg(F.abs(F.col(t) - F.col(f"{t}p"))), F.stddev(t)).first()
        assert error < 0.5 * spread


def test_mean_of_training_rows(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    assert [r.a for r in impute_mean(df, ["a"]).collect()] == [1.0, 3.0, 2.0]
    train = spark.createDataFrame([(10.0,)], "a double")
    assert impute_mean(df, ["a"], train).where("a = 10").count() == 1


def test_forecasts_and_errors_are_shown_beside_the_mean(spark, tables):
    """A model that answers 0 for every cell would fail here."""
    train, test = tables
    preset = replace(trees.FOREST["full"], **SMALL)
    cells = model_queries.beside_mean(jobs.full_forecast(train, test, preset).forecast, train)
    assert cells.columns[-3:] == ["predict", "error", "mean_error"]
    error, mean = cells.agg(F.avg("error"), F.avg("mean_error")).first()
    assert error < mean
    shown = model_queries.errors_beside_mean(trees.validate(trees.fit_forest(train, preset), test), train, test).collect()
    assert {r.metric for r in shown} == {"mae", "rmse"} and all(0 < r.value < r.mean_value for r in shown)


def test_all_model_parameters(spark):
    rows = model_queries.REGISTRY["model_parameters_all"](spark, "/root/testdata/sf0.001").collect()
    assert int(dict(map(tuple, rows))["maxBins"]) > 66
