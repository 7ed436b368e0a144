"""Forests and boosted trees for gaps and traffic levels."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GAP_COLUMNS, LEVELS, TRAFFIC_COLUMNS
from ..operators.prepare import index_categories
from ..operators.quality import constant_columns

GAP_CATEGORIES = ["day", "timeslice", "districtID", "destDistrict", "weather"]
TRAFFIC_CATEGORIES = ["day", "timeslice", "district"]


@dataclass(frozen=True)
class Preset:
    """What to learn from, and how large a model to grow."""

    response: str = "gap"
    categories: tuple[str, ...] = tuple(GAP_CATEGORIES)
    ignored: tuple[str, ...] = ("id", "weather", "temp")
    drop_constant: bool = True
    trees: int = 30
    depth: int = 30
    bins: int = 20
    seed: int = 1
    step: float = 0.1


# The published model configurations.
FOREST = {
    "full": Preset(drop_constant=False, trees=30, depth=30, seed=2908843745901846058),
    "short": Preset(
        ignored=("id", "weather", "temp", "day"), trees=10, depth=20, seed=-584220444440873026
    ),
    "raw": Preset(
        categories=("timeslice", "districtID", "destDistrict", "weather"),
        ignored=("id", "weather"),
        trees=10,
        depth=20,
    ),
    "traffic": Preset(categories=tuple(TRAFFIC_CATEGORIES), ignored=(), trees=50, depth=20, seed=1),
}
# Depth and step are not part of the published configurations.
BOOSTED = {
    "full": replace(FOREST["full"], drop_constant=True, trees=100, depth=5),
    "short": replace(FOREST["short"], trees=100, depth=5),
    "raw": replace(FOREST["raw"], trees=10, depth=5),
}


def feature_columns(preset: Preset, columns: list[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns left after the response and the ignored ones."""
    left = [c for c in columns if c not in (*preset.ignored, preset.response)]
    return [c for c in left if c in preset.categories], [c for c in left if c not in preset.categories]


def feature_stages(categories: list[str], numbers: list[str]) -> list:
    """Index categories (an unseen one gets an index of its own), fill NULLs, assemble.

    The fit reads the training rows only.
    """
    indexed = [f"{c}_ix" for c in categories]
    filled = [f"{c}_num" for c in numbers]
    return [
        index_categories(categories, indexed),
        Imputer(strategy="mean", inputCols=numbers, outputCols=filled),
        VectorAssembler(inputCols=[*indexed, *filled], outputCol="features"),
    ]


def _prepare(df: DataFrame, preset: Preset, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Cast the inputs, drop rows without response, and pick the columns to learn from."""
    categories, numbers = feature_columns(preset, columns)
    df = df.where(F.col(f"`{preset.response}`").isNotNull())
    if preset.drop_constant:
        # One row per column comes back to the driver.
        flagged = constant_columns(df, categories + [f"`{c}`" for c in numbers]).where("is_const")
        const = {r["name"].strip("`") for r in flagged.collect()}
        categories = [c for c in categories if c not in const]
        numbers = [c for c in numbers if c not in const]
    return df, categories, numbers


def _fit(df: DataFrame, preset: Preset, columns: list[str], make, output: str) -> PipelineModel:
    df, categories, numbers = _prepare(df, preset, columns)
    stages = feature_stages(categories, numbers)
    indexer = stages[0].fit(df)
    # Spark splits a categorical feature only if every level has a bin.
    widest = max((len(labels) + 1 for labels in indexer.labelsArray), default=2)
    estimator = make(max(preset.bins, widest)).setPredictionCol(output)
    estimator = estimator.setLabelCol(preset.response).setFeaturesCol("features")
    return Pipeline(stages=[indexer, *stages[1:], estimator]).fit(df)


def fit_forest(
    df: DataFrame,
    preset: Preset | str = "full",
    columns: list[str] = GAP_COLUMNS,
    output: str = "predict",
) -> PipelineModel:
    """Forest without replacement on 63.2% of rows per tree, a third of columns per split."""
    preset = FOREST[preset] if isinstance(preset, str) else preset

    def make(bins: int) -> RandomForestRegressor:
        return RandomForestRegressor(
            numTrees=preset.trees,
            maxDepth=preset.depth,
            maxBins=bins,
            featureSubsetStrategy="onethird",
            bootstrap=False,
            subsamplingRate=0.632,
            seed=preset.seed,
        )

    return _fit(df, preset, columns, make, output)


def fit_boosted(
    df: DataFrame,
    preset: Preset | str = "full",
    columns: list[str] = GAP_COLUMNS,
    output: str = "predict",
) -> PipelineModel:
    preset = BOOSTED[preset] if isinstance(preset, str) else preset

    def make(bins: int) -> GBTRegressor:
        return GBTRegressor(
            maxIter=preset.trees,
            maxDepth=preset.depth,
            maxBins=bins,
            stepSize=preset.step,
            seed=preset.seed,
        )

    return _fit(df, preset, columns, make, output)


def fit_traffic_levels(df: DataFrame, preset: Preset | str = "traffic") -> dict[str, PipelineModel]:
    """One forest per traffic level; the other three levels are left out of its features."""
    preset = FOREST[preset] if isinstance(preset, str) else preset
    return {
        t: fit_forest(
            df,
            replace(preset, response=t, ignored=tuple(o for o in LEVELS if o != t)),
            TRAFFIC_COLUMNS,
            output=f"{t}p",
        )
        for t in LEVELS
    }


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append the prediction; helper columns of the model are dropped again."""
    output = model.stages[-1].getPredictionCol()
    return model.transform(df).select(*[f"`{c}`" for c in df.columns], output)


def score_traffic(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Append t1p..t4p to a traffic table."""
    for model in models.values():
        df = score(model, df)
    return df.select("date", "district", "timeslice", *LEVELS, *[f"{t}p" for t in LEVELS])


def errors_by_tree(model: PipelineModel, df: DataFrame, response: str = "gap") -> DataFrame:
    """(trees, metric, value) of a forest after each of its trees, in one pass.

    Every tree forecasts a row once; the running means over the trees are
    compared with the response in one aggregate, so no prefix is scored again.
    """
    ready = PipelineModel(model.stages[:-1]).transform(df)
    trees = model.stages[-1].trees
    for k, tree in enumerate(trees):
        ready = tree.copy({tree.predictionCol: f"__tree{k}"}).transform(ready)
    total, aggs = F.lit(0.0), []
    for k in range(len(trees)):
        total = total + F.col(f"__tree{k}")
        off = total / (k + 1) - F.col(response)
        aggs.append(F.struct(F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")).alias(f"e{k}"))
    sums = ready.select(response, *(f"__tree{k}" for k in range(len(trees)))).agg(*aggs)
    rows = [
        F.struct(F.lit(k + 1).alias("trees"), F.lit(m).alias("metric"), F.col(f"e{k}.{m}").alias("value"))
        for k in range(len(trees)) for m in ("mae", "rmse")
    ]
    return sums.select(F.inline(F.array(*rows)))


def validate(model: PipelineModel, df: DataFrame, response: str = "gap") -> DataFrame:
    """(trees, metric, value) on held-out rows after each tree or boosting round."""
    final = model.stages[-1]
    if not isinstance(final, GBTRegressionModel):
        return errors_by_tree(model, df, response)
    ready = PipelineModel(model.stages[:-1]).transform(df)
    errors = final.evaluateEachIteration(ready, "absolute")
    return df.sparkSession.createDataFrame([(k, "mae", float(e)) for k, e in enumerate(errors, start=1)], "trees int, metric string, value double")
