"""Weather-code classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_weather_code(grid: DataFrame) -> PipelineModel:
    """Naive Bayes of the weather code on day and slot; unobserved slots do not train."""
    seen = grid.where(F.col("weather").isNotNull())
    label = StringIndexer(
        inputCol="weather", outputCol="label", stringOrderType="alphabetAsc"
    ).fit(seen)
    labelled = label.transform(seen)
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=["day", "timeslice"], outputCol="features"),
            NaiveBayes(modelType="gaussian", labelCol="label", predictionCol="label_ix"),
            IndexToString(inputCol="label_ix", outputCol="code", labels=label.labels),
        ]
    )
    return model.fit(labelled)


def score_weather(model: PipelineModel, grid: DataFrame) -> DataFrame:
    """Append the predicted weather code."""
    return model.transform(grid).select(*grid.columns, F.col("code").cast("int").alias("predict"))
