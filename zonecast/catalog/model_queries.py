"""Registered queries that train models.

Each job is there twice.  The queries with SQL use every row of the tables on a
calendar of wider slots (8 hours for the gap matrix, 1 hour for traffic), most
with small models, and show keys, gaps and properties of the forecast that must
hold.  Those without SQL (``…_forecast``, ``…_errors``, ``model_parameters_all``,
``end_to_end_values``) work on ten-minute slots and show the forecasts, and errors
beside those of the mean of the training rows: the gap forests in their published
size on packed cells of all days, the others on the days of the short job.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LEVELS, TEST_DAYS, TRAFFIC_COLUMNS, TRAIN_DAYS, GridConfig
from ..fixtures import Inputs
from ..models import net, packed, trees
from ..operators import poi
from ..operators.forecasts import forecast_rollup
from ..operators.split import day_split
from ..plans import features as pf
from ..plans import forecast as jobs
from ..session import new_path, stage
from ..sources.writers import load_model, model_params, save_model
from .queries import REGISTRY, norm_matrix, query  # noqa: F401

WIDE = GridConfig(slot_seconds=8 * 3600)
HOURLY = GridConfig(slot_seconds=3600)
SMALL = {"trees": 5, "depth": 5}


def _on(i: Inputs, cfg: GridConfig) -> Inputs:
    return Inputs(i.spark, i.sf_dir, cfg)


def _gap_tables(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Written once: training reads it many times."""
    matrix = stage(norm_matrix(_on(i, WIDE)), "gap_features")
    return day_split(matrix, TRAIN_DAYS, TEST_DAYS)


def _shown(forecast: DataFrame, train: DataFrame, n_dests: int = DEFAULT.n_zones + 1) -> DataFrame:
    """Each cell with its gap, and whether the forecast is one that a mean of training rows can be.

    A tree averages responses, so the sum over the destinations of a zone lies
    between 0 and ``n_dests`` times the largest response.
    """
    top = train.agg(F.max("gap")).first()[0]
    inside = F.col("predict").between(0.0, float(top) * n_dests)
    return forecast.select(F.col("date").cast("string").alias("date"), "timeslice", "districtID", "gap", inside.alias("in_range"))


def _small(preset: trees.Preset) -> trees.Preset:
    return replace(preset, **SMALL)


@query
def rf_gap_full(i: Inputs) -> DataFrame:
    train, test = _gap_tables(i)
    return _shown(jobs.full_forecast(train, test, _small(trees.FOREST["full"])).forecast, train)


@query
def rf_gap_short(i: Inputs) -> DataFrame:
    """The published model (10 trees of depth 20); only its three days are built."""
    w = _on(i, WIDE)
    days = [*jobs.SHORT_TRAIN, *jobs.SHORT_TEST]
    c = jobs.Cleaned(w.days, w.gaps, w.traffic, w.weather, poi.poi_pivot(w.poi)).of_days(days)
    matrix = stage(pf.features_norm(c.days, c.gaps, c.traffic, c.weather, c.poi, w.cfg), "gap_features", "date")
    train, _ = day_split(matrix, jobs.SHORT_TRAIN, jobs.SHORT_TEST)
    return _shown(jobs.short_forecast(matrix).forecast, train)


@query
def rf_gap_raw(i: Inputs) -> DataFrame:
    """Error per test day of a forest on the raw matrix."""
    w = _on(i, WIDE)
    pivot = poi.poi_pivot(w.poi, scaled=False)
    matrix = stage(
        pf.features_raw(w.days, w.gaps, w.traffic, w.weather, pivot, w.cfg), "gap_raw"
    )
    train, test = day_split(matrix, TRAIN_DAYS, TEST_DAYS)
    result = jobs.raw_forecast(train, test, _small(trees.FOREST["raw"]))
    worst = float(train.agg(F.max("gap")).first()[0]) * (DEFAULT.n_zones + 1)
    return result.validation.select(
        F.col("date").cast("string").alias("date"), F.col("mae").between(0.0, worst).alias("mae_ok")
    )


@query
def gbt_gap(i: Inputs) -> DataFrame:
    train, test = _gap_tables(i)
    preset = replace(trees.BOOSTED["raw"], **SMALL)
    scored = forecast_rollup(trees.score(trees.fit_boosted(train, preset), test))
    return _shown(scored, train)


def _measured(errors: DataFrame, train: DataFrame) -> DataFrame:
    """An error on held-out rows lies between 0 and the largest response."""
    top = float(train.agg(F.max("gap")).first()[0])
    return errors.select("trees", "metric", F.col("value").between(0.0, top).alias("value_ok"))


@query
def gbt_validation(i: Inputs) -> DataFrame:
    """Mean absolute error on the test days after each boosting round."""
    train, test = _gap_tables(i)
    model = trees.fit_boosted(train, replace(trees.BOOSTED["full"], trees=3, depth=4))
    return _measured(trees.validate(model, test), train)


@query
def rf_validation(i: Inputs) -> DataFrame:
    train, test = _gap_tables(i)
    model = trees.fit_forest(train, replace(trees.FOREST["full"], trees=3, depth=4))
    return _measured(trees.validate(model, test), train)


@query
def mlp_gap(i: Inputs) -> DataFrame:
    train, test = _gap_tables(i)
    model = net.fit_net(train, "short", epochs=1)
    return _shown(forecast_rollup(model.transform(test)), train)


def _traffic_tables(i: Inputs) -> tuple[DataFrame, DataFrame]:
    h = _on(i, HOURLY)
    pivot = poi.poi_pivot(h.poi)
    dense = stage(pf.traffic_train(h.days, h.traffic, h.weather, pivot, h.cfg), "traffic_train")
    sparse = stage(
        pf.traffic_predict_grid(h.days, h.traffic, h.weather, pivot, h.cfg), "traffic_predict"
    )
    return day_split(dense, TRAIN_DAYS, TEST_DAYS)[0], day_split(sparse, TRAIN_DAYS, TEST_DAYS)[1]


@query
def rf_traffic_levels(i: Inputs) -> DataFrame:
    train, predict = _traffic_tables(i)
    scored = jobs.traffic_forecast(train, predict, replace(trees.FOREST["traffic"], trees=4, depth=5))
    ends = train.agg(*[f(t).alias(f"{f.__name__}_{t}") for t in LEVELS for f in (F.min, F.max)]).first()
    inside = [F.col(f"{t}p").between(ends[f"min_{t}"] - 1e-9, ends[f"max_{t}"] + 1e-9) for t in LEVELS]
    levels = [F.round(t, 6).alias(t) for t in LEVELS]
    return scored.select(
        F.col("date").cast("string").alias("date"), "district", "timeslice", *levels,
        (inside[0] & inside[1] & inside[2] & inside[3]).alias("in_range"),
    )


@query
def nb_weather(i: Inputs) -> DataFrame:
    grid = pf.weather_table(i.days, i.weather)
    train, test = day_split(stage(grid, "weather_grid"), TRAIN_DAYS, TEST_DAYS)
    return jobs.weather_forecast(train, test).select("day", "timeslice", "weather", "predict")


@query
def model_roundtrip(i: Inputs) -> DataFrame:
    """Does a model forecast the same before it is saved and after it is loaded?"""
    train, test = _gap_tables(i)
    model = trees.fit_forest(train, replace(trees.FOREST["short"], trees=3, depth=4))
    path = new_path(i.spark, "model")
    save_model(model, path)
    before = forecast_rollup(trees.score(model, test)).withColumnRenamed("predict", "saved")
    keys = ["date", "timeslice", "districtID"]
    after = jobs.rescore(path, test).withColumnRenamed("predict", "loaded")
    both = before.join(after.drop("gap"), keys)
    return both.select(
        F.col("date").cast("string").alias("date"),
        "timeslice",
        "districtID",
        "gap",
        (F.col("saved") == F.col("loaded")).alias("same"),
    )


@query
def model_parameters(i: Inputs) -> DataFrame:
    """Parameters of a loaded model."""
    train, _ = _traffic_tables(i)
    path = new_path(i.spark, "model")
    preset = replace(trees.FOREST["traffic"], response="t1", ignored=("t2", "t3", "t4"), trees=2, depth=3)
    save_model(trees.fit_forest(train, preset, TRAFFIC_COLUMNS), path)
    params = model_params(load_model(path))
    return i.spark.createDataFrame(sorted(params.items()), "name string, value string").where(
        "name IN ('numTrees', 'maxDepth', 'seed')"
    )


@query
def end_to_end_forecast(i: Inputs) -> DataFrame:
    """Traffic tables to merged forecast in one go."""
    w = _on(i, WIDE)
    inputs = jobs.Cleaned(w.days, w.gaps, w.traffic, w.weather, poi.poi_pivot(w.poi))
    merged = jobs.end_to_end(
        inputs,
        TRAIN_DAYS,
        TEST_DAYS,
        new_path(i.spark, "end_to_end"),
        w.cfg,
        replace(trees.FOREST["traffic"], trees=3, depth=4),
        _small(trees.FOREST["full"]),
    )
    return merged.select("timeslice", "districtID", "gap", (F.col("predict") >= 0).alias("in_range"))


# Without SQL: published models on ten-minute slots, with their forecasts and errors.


def _short_matrix(i: Inputs) -> DataFrame:
    c = jobs.Cleaned(i.days, i.gaps, i.traffic, i.weather, poi.poi_pivot(i.poi))
    c = c.of_days([*jobs.SHORT_TRAIN, *jobs.SHORT_TEST])
    return stage(pf.features_norm(c.days, c.gaps, c.traffic, c.weather, c.poi, i.cfg), "gap_features", "date")


def beside_mean(forecast: DataFrame, train: DataFrame) -> DataFrame:
    """Each cell's gap and forecast, its error, and the error of the mean cell of the training rows (or packed cells)."""
    if "gaps" in train.columns:
        train = train.withColumn("gap", _total_gap())
    cells = train.groupBy("date", "timeslice", "districtID").agg(F.sum("gap").alias("gap"))
    mean = float(cells.agg(F.avg("gap")).first()[0])
    return forecast.select(
        F.col("date").cast("string").alias("date"), "timeslice", "districtID", "gap", "predict",
        F.abs(F.col("predict") - F.col("gap")).alias("error"), F.abs(F.col("gap") - mean).alias("mean_error"),
    )


def errors_beside_mean(errors: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(trees, metric, value, mean_value): held-out errors beside those of the mean of the training rows."""
    off = F.col("gap") - float(train.agg(F.avg("gap")).first()[0])
    mae, rmse = test.agg(F.avg(F.abs(off)), F.sqrt(F.avg(off * off))).first()
    return errors.withColumn("mean_value", F.when(F.col("metric") == "mae", mae).otherwise(rmse))


def _total_gap():
    none = F.array().cast("array<bigint>")
    return F.aggregate(F.coalesce(F.map_values("gaps"), none), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def packed_errors_beside_mean(errors: DataFrame, train: DataFrame, test: DataFrame, n_dests: int) -> DataFrame:
    """``errors_beside_mean`` for packed cells, each of which stands for ``n_dests`` rows."""
    one = train.agg(F.sum(_total_gap()) / (n_dests * F.count(F.lit(1)))).first()[0]
    off = F.transform(F.coalesce(F.map_values("gaps"), F.array().cast("array<bigint>")), lambda g: g - F.lit(one))
    zeros = n_dests - F.size(off)
    total = lambda f: F.aggregate(off, F.lit(0.0), lambda acc, x: acc + f(x))
    mae, square = test.agg(
        F.sum(total(F.abs) + zeros * abs(one)) / (n_dests * F.count(F.lit(1))),
        F.sum(total(lambda x: x * x) + zeros * one * one) / (n_dests * F.count(F.lit(1))),
    ).first()
    return errors.withColumn("mean_value", F.when(F.col("metric") == "mae", mae).otherwise(square**0.5))


def _packed_tables(i: Inputs) -> tuple[DataFrame, DataFrame]:
    cells = pf.features_norm(i.days, i.gaps, i.traffic, i.weather, poi.poi_pivot(i.poi), i.cfg, packed=True)
    return day_split(stage(cells, "gap_cells"), TRAIN_DAYS, TEST_DAYS)


@query
def rf_gap_full_forecast(i: Inputs) -> DataFrame:
    train, test = _packed_tables(i)
    return beside_mean(jobs.packed_full_forecast(train, test).forecast, train)


@query
def rf_gap_short_forecast(i: Inputs) -> DataFrame:
    matrix = _short_matrix(i)
    train, _ = day_split(matrix, jobs.SHORT_TRAIN, jobs.SHORT_TEST)
    return beside_mean(jobs.short_forecast(matrix).forecast, train)


@query
def rf_gap_raw_errors(i: Inputs) -> DataFrame:
    """(date, mae, mean_mae) of the test days."""
    pivot = poi.poi_pivot(i.poi, scaled=False)
    cells = stage(pf.features_raw(i.days, i.gaps, i.traffic, i.weather, pivot, i.cfg, packed=True), "raw_cells")
    train, test = day_split(cells, TRAIN_DAYS, TEST_DAYS)
    shown = beside_mean(jobs.packed_raw_forecast(train, test).forecast, train)
    return shown.groupBy("date").agg(F.avg("error").alias("mae"), F.avg("mean_error").alias("mean_mae"))


@query
def rf_validation_errors(i: Inputs) -> DataFrame:
    """Errors on the test days after each of the 30 trees of the published forest."""
    train, test = _packed_tables(i)
    preset, n_dests = trees.FOREST["full"], i.cfg.n_zones + 1
    model = packed.fit_packed(packed.gap_cells(train, preset, i.cfg), preset)
    errors = model.errors_by_tree(packed.gap_cells(test, preset, i.cfg)).drop("target")
    return packed_errors_beside_mean(errors, train, test, n_dests)


def _short_tables(i: Inputs) -> tuple[DataFrame, DataFrame]:
    return day_split(_short_matrix(i), jobs.SHORT_TRAIN, jobs.SHORT_TEST)


@query
def gbt_gap_forecast(i: Inputs) -> DataFrame:
    """Boosted trees on the two training days of the short job, forecast of its test day."""
    train, test = _short_tables(i)
    return beside_mean(forecast_rollup(trees.score(trees.fit_boosted(train, "raw"), test)), train)


@query
def gbt_validation_errors(i: Inputs) -> DataFrame:
    """Error on the short job's test day after each boosting round."""
    train, test = _short_tables(i)
    return errors_beside_mean(trees.validate(trees.fit_boosted(train, "raw"), test), train, test)


@query
def mlp_gap_forecast(i: Inputs) -> DataFrame:
    """The short job's net, trained on its two days."""
    train, test = _short_tables(i)
    return beside_mean(forecast_rollup(net.fit_net(train, "short").transform(test)), train)


#: Depth of the traffic forests that end here: the published 20 gives a leaf for nearly every row of 200 trees.
TRAFFIC_DEPTH = 10


@query
def rf_traffic_levels_forecast(i: Inputs) -> DataFrame:
    """Observed and forecast levels of every cell of the short job's test day."""
    pivot = poi.poi_pivot(i.poi)
    c = jobs.Cleaned(i.days, i.gaps, i.traffic, i.weather, pivot)
    train, test = c.of_days(jobs.SHORT_TRAIN), c.of_days(jobs.SHORT_TEST)
    dense = stage(pf.traffic_train(train.days, train.traffic, train.weather, pivot, i.cfg), "traffic_train")
    sparse = stage(pf.traffic_predict_grid(test.days, test.traffic, test.weather, pivot, i.cfg), "traffic_predict")
    preset = replace(trees.FOREST["traffic"], depth=TRAFFIC_DEPTH)
    return jobs.packed_traffic_forecast(dense, sparse, preset).withColumn("date", F.col("date").cast("string"))


@query
def model_parameters_all(i: Inputs) -> DataFrame:
    """Every parameter of the loaded model of ``model_parameters``, maxBins among them."""
    train, _ = _traffic_tables(i)
    path = new_path(i.spark, "model")
    preset = replace(trees.FOREST["traffic"], response="t1", ignored=("t2", "t3", "t4"), trees=2, depth=3)
    save_model(trees.fit_forest(train, preset, TRAFFIC_COLUMNS), path)
    return i.spark.createDataFrame(sorted(model_params(load_model(path)).items()), "name string, value string")


@query
def end_to_end_values(i: Inputs) -> DataFrame:
    """The merged forecast of the short job's days: its published gap forest, traffic forests of ``TRAFFIC_DEPTH``."""
    inputs = jobs.Cleaned(i.days, i.gaps, i.traffic, i.weather, poi.poi_pivot(i.poi))
    merged = jobs.end_to_end(
        inputs, jobs.SHORT_TRAIN, jobs.SHORT_TEST, new_path(i.spark, "end_to_end"), i.cfg,
        replace(trees.FOREST["traffic"], depth=TRAFFIC_DEPTH), trees.FOREST["short"], packed=True,
    )
    return merged.select("timeslice", "districtID", "gap", "predict")
