"""Preparation of feature columns for training."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.sql import DataFrame


def impute_mean(df: DataFrame, cols: list[str], train: DataFrame | None = None) -> DataFrame:
    """Replace NULL by the mean of the training rows (default: of ``df``).  Runs one aggregate."""
    model = Imputer(strategy="mean", inputCols=cols, outputCols=cols).fit(train or df)
    return model.transform(df)


def index_categories(cols: list[str], outputs: list[str]) -> StringIndexer:
    """Index columns by the text order of their values; an unseen value gets an index of its own."""
    return StringIndexer(
        inputCols=cols, outputCols=outputs, handleInvalid="keep", stringOrderType="alphabetAsc"
    )
