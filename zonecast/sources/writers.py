"""Writers.  No table passes through the driver or through one task."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slot_label


def write_daily(df: DataFrame, path: str, fmt: str = "parquet", date_col: str = "date") -> None:
    """One folder per day; days that ``df`` does not hold stay as they are.

    Only the folders of the days in ``df`` are replaced, and only when the whole
    write has ended: a write that fails leaves the old days.  Each task writes the
    days it holds, so a hot day is spread like any other.
    """
    writer = df.write.mode("overwrite").partitionBy(date_col).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_forecast(df: DataFrame, path: str) -> None:
    """Forecast rows as headed CSV, one folder per day."""
    cols = ["date", "timeslice", "districtID", "gap", "predict"]
    write_daily(df.select(*cols), path, fmt="csv")


def write_merged(forecast: DataFrame, path: str) -> None:
    """All days as one headed CSV folder, its parts in (day, slot, zone) order."""
    keys = ["date", "timeslice", "districtID"]
    (
        forecast.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(
            slot_label("date", "timeslice").alias("timeslice"),
            "districtID",
            F.col("gap").cast("bigint").alias("gap"),
            "predict",
        )
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_params(model: PipelineModel) -> dict[str, str]:
    """Parameters of the last stage, by name."""
    stage = model.stages[-1]
    return {p.name: str(v) for p, v in stage.extractParamMap().items()}
