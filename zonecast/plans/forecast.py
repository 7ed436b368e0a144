"""Forecast jobs: split, train, score, threshold, roll up, write, merge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, LEVELS, GridConfig, month_dates
from ..functions.scalars import od_encode
from ..models.packed import PackedForest, fit_packed, gap_cells, rollup, traffic_cells
from ..models.trees import (
    FOREST,
    Preset,
    fit_forest,
    fit_traffic_levels,
    score,
    score_traffic,
    validate,
)
from ..models.weather import fit_weather_code, score_weather
from ..operators.forecasts import forecast_rollup, mean_abs_error, merge_forecasts
from ..operators.split import day_split, hash_split, in_train
from ..session import remove, stage
from ..sources.writers import load_model, save_model, write_forecast, write_merged
from . import features as pf
from .stages import Stages

if TYPE_CHECKING:
    from .clean import RawPaths


# Two days to learn from, one to forecast.
SHORT_TRAIN, SHORT_TEST = month_dates([20, 21]), month_dates([22])


@dataclass
class GapForecast:
    model: PipelineModel | PackedForest
    forecast: DataFrame
    """(date, timeslice, districtID, gap, predict)"""
    validation: DataFrame | None = None


def full_forecast(
    train: DataFrame, test: DataFrame, preset: Preset = FOREST["full"], model_path: str | None = None
) -> GapForecast:
    """Train on 80% of the training rows, validate on the rest, score the test days.

    The split follows the keys of a row: unlike a random split it sorts nothing and
    gives the same parts however the table is partitioned or recomputed.
    """
    fit_rows, held_out = hash_split(train, "id")
    model = fit_forest(fit_rows, preset)
    if model_path:
        save_model(model, model_path)
    return GapForecast(model, forecast_rollup(score(model, test)), validate(model, held_out))


def short_forecast(
    features: DataFrame,
    train_days: list[dt.date] = SHORT_TRAIN,
    test_days: list[dt.date] = SHORT_TEST,
    preset: Preset = FOREST["short"],
) -> GapForecast:
    """Two days to learn from, one to forecast."""
    train, test = day_split(features, train_days, test_days)
    model = fit_forest(train, preset)
    return GapForecast(model, forecast_rollup(score(model, test)))


def raw_forecast(train: DataFrame, test: DataFrame, preset: Preset = FOREST["raw"]) -> GapForecast:
    """On raw features, without a threshold; ``validation`` is the error per day."""
    model = fit_forest(train, preset)
    rollup = forecast_rollup(score(model, test), cut=None)
    return GapForecast(model, rollup, mean_abs_error(rollup))


def _held(cfg: GridConfig, kept: bool) -> Column:
    """The destinations of a packed cell whose rows are kept for training, or held out; as ``hash_split`` has it."""
    inside = lambda d: in_train(od_encode(F.col("timeslice"), F.col("districtID"), d), "date")
    return F.filter(F.sequence(F.lit(0), F.lit(cfg.n_zones)), lambda d: inside(d) if kept else ~inside(d))


def packed_full_forecast(
    train: DataFrame, test: DataFrame, preset: Preset = FOREST["full"], model_path: str | None = None, cfg: GridConfig = DEFAULT
) -> GapForecast:
    """``full_forecast`` on packed cells: the same rows to learn from and to validate on, never exploded.

    ``validation`` has a line for each tree and metric.
    """
    parted = train.withColumns({"used": _held(cfg, True), "held": _held(cfg, False)})
    model = fit_packed(gap_cells(parted, preset, cfg, "used"), preset)
    if model_path:
        model.save(train.sparkSession, model_path)
    errors = model.errors_by_tree(gap_cells(parted, preset, cfg, "held"))
    return GapForecast(model, packed_rollup(model, test, preset, 0.5, cfg), errors.drop("target"))


def packed_raw_forecast(
    train: DataFrame, test: DataFrame, preset: Preset = FOREST["raw"], cfg: GridConfig = DEFAULT
) -> GapForecast:
    """``raw_forecast`` on packed cells."""
    model = fit_packed(gap_cells(train, preset, cfg), preset)
    forecast = packed_rollup(model, test, preset, None, cfg)
    return GapForecast(model, forecast, mean_abs_error(forecast))


def packed_rollup(
    model: PackedForest, cells: DataFrame, preset: Preset, cut: float | None = 0.5, cfg: GridConfig = DEFAULT
) -> DataFrame:
    """Forecast of packed cells, summed over their destinations."""
    return rollup(model.score(gap_cells(cells, preset, cfg), ["date", "timeslice", "districtID", "gaps"]), cut)


def packed_traffic_forecast(train: DataFrame, predict: DataFrame, preset: Preset = FOREST["traffic"]) -> DataFrame:
    """``traffic_forecast`` with the forests of all four levels grown at once."""
    model = fit_packed(traffic_cells(train, preset), preset)
    keys = ["date", "district", "timeslice", *LEVELS]
    cells = traffic_cells(predict.withColumns({f"{t}_seen": F.col(t) for t in LEVELS}).na.fill(0.0, LEVELS), preset)
    scored = model.score(cells, [*keys[:3], *(f"{t}_seen" for t in LEVELS)])
    return scored.select(
        *keys[:3], *(F.col(f"{t}_seen").alias(t) for t in LEVELS), *(F.col(f"{t}__predict")[0].alias(f"{t}p") for t in LEVELS)
    )


def rescore(model_path: str, test: DataFrame) -> DataFrame:
    """Forecast with a saved model."""
    return forecast_rollup(score(load_model(model_path), test))


def traffic_forecast(
    train: DataFrame, predict: DataFrame, preset: Preset = FOREST["traffic"]
) -> DataFrame:
    """Traffic levels of every cell to predict, observed and modelled."""
    return score_traffic(fit_traffic_levels(train, preset), predict)


def weather_forecast(train: DataFrame, predict: DataFrame) -> DataFrame:
    return score_weather(fit_weather_code(train), predict)


@dataclass
class Cleaned:
    """Sparse inputs of all days, and the days to use."""

    days: DataFrame
    gaps: DataFrame
    traffic: DataFrame
    weather: DataFrame
    poi: DataFrame
    rejects: DataFrame | None = None
    """Rows of unknown zones, if they were not to fail."""

    def of_days(self, days: list[dt.date]) -> Cleaned:
        keep = F.col("date").isin(days)
        return Cleaned(
            self.days.where(keep),
            self.gaps.where(keep),
            self.traffic.where(keep),
            self.weather.where(keep),
            self.poi,
        )

    def staged(self) -> Cleaned:
        """Write each table once, so that no job rereads the raw rows."""
        return Cleaned(*[stage(getattr(self, n), n) for n in TABLES])


TABLES = ("days", "gaps", "traffic", "weather", "poi")


def end_to_end(
    inputs: Cleaned | Callable[[], Cleaned],
    train_days: list[dt.date],
    test_days: list[dt.date],
    out_dir: str,
    cfg: GridConfig = DEFAULT,
    traffic_preset: Preset = FOREST["traffic"],
    gap_preset: Preset = FOREST["full"],
    packed: bool = False,
) -> DataFrame:
    """Traffic tables, traffic models, gap tables, gap model, forecast, merged output.

    Everything is written below ``out_dir``; the merged forecast is returned.  A
    second call with the same settings goes on after the last step that a call
    before it finished, and ``inputs`` may be a function, which is then not called
    needlessly.  The cleaned tables are removed at the end.  ``packed`` grows the
    forests on packed cells, as large presets need; the gap tables are then cells.
    """
    days = [[str(d) for d in x] for x in (train_days, test_days)]
    spark = SparkSession.getActiveSession() if callable(inputs) else inputs.days.sparkSession
    run = Stages(spark, out_dir, f"{days} {cfg} {traffic_preset} {gap_preset} {packed}")
    if not run.finished("merged"):
        made: list[Cleaned] = []

        def cleaned(name: str) -> DataFrame:
            if not made:
                made.append(inputs() if callable(inputs) else inputs)
            return getattr(made[0], name)

        tables = [run.written(f"cleaned_{n}", lambda n=n: cleaned(n), daily=False) for n in TABLES]
        if callable(inputs) and made and made[0].rejects is not None:
            run.written("rejects", lambda: made[0].rejects, daily=False)
        _forecast_steps(run, Cleaned(*tables), train_days, test_days, cfg, traffic_preset, gap_preset, packed)
    for n in TABLES:
        remove(spark, f"{out_dir}/cleaned_{n}")
    return merge_forecasts(_read_forecast(spark, out_dir))


def _read_forecast(spark: SparkSession, out_dir: str) -> DataFrame:
    schema = "timeslice int, districtID int, gap bigint, predict double, date date"
    return spark.read.schema(schema).option("header", True).csv(f"{out_dir}/forecast")


def _forecast_steps(
    run: Stages, inputs: Cleaned, train_days: list[dt.date], test_days: list[dt.date], cfg: GridConfig,
    traffic_preset: Preset, gap_preset: Preset, packed: bool,
) -> None:
    train, test = inputs.of_days(train_days), inputs.of_days(test_days)

    def args(c: Cleaned) -> tuple:
        return c.days, c.traffic, c.weather, c.poi, cfg

    traffic_train = run.written("traffic_train", lambda: pf.traffic_train(*args(train)))
    run.written("traffic_observed", lambda: pf.traffic_observed(*args(test)))
    to_predict = run.written("traffic_predict", lambda: pf.traffic_predict_grid(*args(test)))
    job = packed_traffic_forecast if packed else traffic_forecast
    levels = run.written("traffic_scored", lambda: job(traffic_train, to_predict, traffic_preset))
    levels = levels.withColumnsRenamed({"district": "zone", "timeslice": "slot"})
    gap_train = run.written(
        "gap_train", lambda: pf.features_norm(train.days, train.gaps, train.traffic, train.weather, train.poi, cfg, packed)
    )
    gap_test = run.written("gap_test", lambda: pf.features_test(test.days, test.gaps, levels, test.weather, test.poi, cfg, packed))

    def forecast() -> DataFrame:
        model_path = f"{run.out_dir}/gap_model"
        if packed:
            return packed_full_forecast(gap_train, gap_test, gap_preset, model_path, cfg).forecast
        return full_forecast(gap_train, gap_test, gap_preset, model_path).forecast

    run.step("forecast", lambda: write_forecast(forecast(), f"{run.out_dir}/forecast"))
    run.step("merged", lambda: write_merged(_read_forecast(run.spark, run.out_dir), f"{run.out_dir}/merged"))


def run_files(
    spark: SparkSession, paths: RawPaths, train_days: list[dt.date], test_days: list[dt.date], out_dir: str,
    cfg: GridConfig = DEFAULT, strict: bool = True, **how,
) -> DataFrame:
    """Files to merged forecast in one call, restartable like ``end_to_end``, whose further arguments it takes."""
    from .clean import clean

    return end_to_end(lambda: clean(spark, paths, cfg, strict)[0], train_days, test_days, out_dir, cfg, **how)
