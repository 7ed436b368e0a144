"""Neural-net gap regressor: data-parallel training by weight averaging.

Spark ML has no multilayer regressor.  Rows are dealt to a fixed number of
replicas by a hash, and ordered by it, so what a replica sees does not depend on
how the table is partitioned.  In each epoch every replica goes through its rows
in mini-batches; the weights and the step accumulators of all replicas are then
averaged by their rows and go into the next epoch.  The driver only ever holds one
set of weights, whose size depends on the layers and not on the data.

``NetRegressor`` and ``NetModel`` are an estimator and a model of Spark ML: they
take their place in a pipeline, and are saved and loaded with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GAP_COLUMNS
from ..operators.prepare import index_categories
from ..session import ship_package, stage
from .trees import Preset, feature_columns

# Decay and smoothing of the adaptive step; what the published nets learn from, and their epochs.
RHO, EPSILON = 0.99, 1e-8
PRESETS = {
    "full": (Preset(ignored=("id", "weather")), 5),
    "short": (Preset(ignored=("id", "weather", "temp", "day")), 1),
}


@dataclass(frozen=True)
class Shape:
    """Level counts of the categorical inputs, number of numeric inputs, hidden widths."""

    levels: tuple[int, ...]
    numbers: int
    hidden: tuple[int, ...]

    @property
    def sizes(self) -> list[int]:
        return [sum(self.levels) + self.numbers, *self.hidden, 1]

    def unpack(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of one flat vector as (weights, bias) per layer."""
        layers, at = [], 0
        for n, m in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            w = flat[at : at + n * m].reshape(n, m)
            layers.append((w, flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return layers

    def start(self, seed: int) -> np.ndarray:
        """Uniform start weights scaled by layer width; zero biases."""
        rng, parts = np.random.default_rng(seed), []
        for n, m in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            limit = np.sqrt(6.0 / (n + m))
            parts += [rng.uniform(-limit, limit, n * m), np.zeros(m)]
        return np.concatenate(parts)

    def encode(self, index: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """One-hot categories beside the numeric inputs."""
        x = np.zeros((len(index), self.sizes[0]))
        at = 0
        for c, levels in enumerate(self.levels):
            x[np.arange(len(index)), at + index[:, c]] = 1.0
            at += levels
        x[:, at:] = numbers
        return x

    def forward(self, layers: list, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer, rectified except the last."""
        acts = [x]
        for k, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(z if k == len(layers) - 1 else np.maximum(z, 0.0))
        return acts

    def gradient(self, layers: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of half the mean squared error, flat."""
        acts = self.forward(layers, x)
        delta = (acts[-1] - y[:, None]) / len(y)
        parts: list[np.ndarray] = []
        for k in range(len(layers) - 1, -1, -1):
            parts = [(acts[k].T @ delta).ravel(), delta.sum(axis=0), *parts]
            if k:
                delta = (delta @ layers[k][0].T) * (acts[k] > 0)
        return np.concatenate(parts)


@dataclass
class _State:
    """Weights, and the running squares of gradients and steps."""

    w: np.ndarray
    grad2: np.ndarray
    step2: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray) -> _State:
        return cls(*(x.copy() for x in flat.reshape(3, -1)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w, self.grad2, self.step2])

    def step(self, g: np.ndarray) -> None:
        self.grad2 *= RHO
        self.grad2 += (1.0 - RHO) * g * g
        move = np.sqrt(self.step2 + EPSILON) / np.sqrt(self.grad2 + EPSILON) * g
        self.step2 *= RHO
        self.step2 += (1.0 - RHO) * move * move
        self.w -= move


def _rows(batch: pa.RecordBatch, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replica, inputs and response of the rows of a batch."""
    n = batch.num_rows
    index = batch.column("ix").flatten().to_numpy(zero_copy_only=False).reshape(n, len(shape.levels)).astype(np.int64)
    numbers = batch.column("num").flatten().to_numpy(zero_copy_only=False).reshape(n, shape.numbers)
    return batch.column("replica").to_numpy(), shape.encode(index, numbers), batch.column("y").to_numpy(zero_copy_only=False)


def _train(shape: Shape, shared, batch_rows: int):
    """mapInArrow function: one pass over rows that come replica by replica, in order.

    Rows are gathered to whole mini-batches across the batches that Arrow makes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        at, state, seen = None, None, 0
        x, y = np.empty((0, shape.sizes[0])), np.empty(0)

        def learn(whole: bool) -> None:
            nonlocal x, y, seen
            layers, last = shape.unpack(state.w), len(y) - (0 if whole else len(y) % batch_rows)
            for lo in range(0, last, batch_rows):
                hi = min(lo + batch_rows, last)
                state.step(shape.gradient(layers, x[lo:hi], y[lo:hi]))
            seen += last
            x, y = x[last:], y[last:]

        def ended() -> pa.RecordBatch:
            learn(True)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([state.flat().tobytes()], pa.binary()), pa.array([seen], pa.int64())],
                ["replica", "state", "rows"],
            )

        for batch in batches:
            replica, new_x, new_y = _rows(batch, shape)
            cuts = [0, *(np.flatnonzero(np.diff(replica)) + 1).tolist(), len(replica)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if at != replica[lo]:
                    if at is not None:
                        yield ended()
                    at, state, seen = int(replica[lo]), _State.of(start), 0
                x, y = np.concatenate([x, new_x[lo:hi]]), np.concatenate([y, new_y[lo:hi]])
                learn(False)
        if at is not None:
            yield ended()

    return run


class _NetParams(HasLabelCol, HasPredictionCol, HasSeed):
    levels = Param(Params._dummy(), "levels", "level counts of the categories", TypeConverters.toListInt)
    numbers = Param(Params._dummy(), "numbers", "numeric inputs", TypeConverters.toInt)
    hidden = Param(Params._dummy(), "hidden", "widths of the hidden layers", TypeConverters.toListInt)

    def shape(self) -> Shape:
        get = self.getOrDefault
        return Shape(tuple(get(self.levels)), get(self.numbers), tuple(get(self.hidden)))

    def inputs(self, df: DataFrame) -> list[Column]:
        index = F.array(*[F.col(f"ix{k}").cast("int") for k in range(len(self.getOrDefault(self.levels)))])
        return [index.alias("ix"), vector_to_array("num_vec").alias("num")]


class NetRegressor(Estimator, _NetParams, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Reads ``ix0``… (category indices) and ``num_vec`` (standardised numbers); ``maxIter`` counts epochs."""

    keyCols = Param(Params._dummy(), "keyCols", "columns as they were read, which deal a row to its replica", TypeConverters.toListString)
    replicas = Param(Params._dummy(), "replicas", "copies that train side by side", TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a step", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, levels=None, numbers=None, keyCols=None, hidden=(64, 64, 64), maxIter=1, batchSize=10, replicas=8, seed=1,
        labelCol="gap", predictionCol="predict",
    ):
        super().__init__()
        self._setDefault(hidden=[64, 64, 64], maxIter=1, batchSize=10, replicas=8, seed=1, labelCol="gap", predictionCol="predict")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def dealt(self, df: DataFrame) -> DataFrame:
        """(replica, place, ix, num, y), the same for equal rows in any layout of the table; rows without response go."""
        y = F.col(self.getLabelCol()).cast("double")
        place = F.xxhash64(*(F.col(f"`{c}`") for c in self.getOrDefault(self.keyCols)), y)
        replica = F.pmod(place, F.lit(self.getOrDefault(self.replicas))).cast("int")
        return df.where(y.isNotNull()).select(replica.alias("replica"), place.alias("place"), *self.inputs(df), y.alias("y"))

    def epochs(self, df: DataFrame) -> Iterator[NetModel]:
        """The model after each epoch."""
        spark, shape = df.sparkSession, self.shape()
        ship_package(spark)
        replicas, rows = self.getOrDefault(self.replicas), stage(self.dealt(df), "net-rows")
        n = len(shape.start(0))
        flat = np.concatenate([shape.start(self.getSeed()), np.zeros(2 * n)])
        for _ in range(self.getMaxIter()):
            shared = spark.sparkContext.broadcast(flat)
            ordered = rows.repartition(replicas, "replica").sortWithinPartitions("replica", "place")
            train = _train(shape, shared, self.getOrDefault(self.batchSize))
            # As many rows as there are replicas.
            copies = ordered.mapInArrow(train, "replica int, state binary, rows long").collect()
            copies.sort(key=lambda r: r.replica)
            total = sum(r.rows for r in copies)
            if copies:
                flat = sum(np.frombuffer(r.state, float) * (r.rows / total) for r in copies)
            model = NetModel(weights=flat[:n].tolist(), levels=list(shape.levels), numbers=shape.numbers, hidden=list(shape.hidden))
            yield self._copyValues(model)

    def _fit(self, df: DataFrame) -> NetModel:
        *_, model = self.epochs(df)
        return model


class NetModel(Model, _NetParams, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "all layers' weights and biases end to end", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights=None, levels=None, numbers=None, hidden=None):
        super().__init__()
        self._setDefault(labelCol="gap", predictionCol="predict", seed=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        shape, weights = self.shape(), np.array(self.getOrDefault(self.weights))
        ship_package(df.sparkSession)

        @F.pandas_udf("double")
        def predict(ix: pd.Series, num: pd.Series) -> pd.Series:
            if ix.empty:
                return pd.Series([], dtype=float)
            x = shape.encode(np.stack(ix.to_numpy()).astype(np.int64), np.stack(num.to_numpy()))
            return pd.Series(shape.forward(shape.unpack(weights), x)[-1][:, 0])

        return df.withColumn(self.getPredictionCol(), predict(*self.inputs(df)))


def fit_net(
    df: DataFrame,
    preset: Preset | str = "full",
    hidden: tuple[int, ...] = (64, 64, 64),
    epochs: int | None = None,
    batch: int = 10,
    columns: list[str] = GAP_COLUMNS,
    replicas: int = 8,
) -> PipelineModel:
    """Index, fill and standardise the inputs, then train; a pipeline that ``save_model`` writes.

    Numeric inputs are mean-filled and standardised in every preset.
    """
    prep, net = _stages(df, preset, hidden, epochs, batch, columns, replicas)
    return PipelineModel([*prep.stages, net.fit(prep.transform(df))])


def errors_by_epoch(
    df: DataFrame, held_out: DataFrame, preset: Preset | str = "full", hidden: tuple[int, ...] = (64, 64, 64), epochs: int | None = None,
    columns: list[str] = GAP_COLUMNS, **how,
) -> tuple[PipelineModel, DataFrame]:
    """The trained pipeline, and (epoch, metric, value) on held-out rows after each epoch.

    An epoch's model is scored in one aggregate; training goes on from its weights and accumulators.
    """
    prep, net = _stages(df, preset, hidden, epochs, how.get("batch", 10), columns, how.get("replicas", 8))
    ready, test, lines = prep.transform(df), prep.transform(held_out), []
    for epoch, model in enumerate(net.epochs(ready), start=1):
        off = F.col(model.getPredictionCol()) - F.col(net.getLabelCol())
        mae, rmse = model.transform(test).agg(F.avg(F.abs(off)), F.sqrt(F.avg(off * off))).first()
        lines += [(epoch, "mae", mae), (epoch, "rmse", rmse)]
    return PipelineModel([*prep.stages, model]), df.sparkSession.createDataFrame(lines, "epoch int, metric string, value double")


def _stages(df, preset, hidden, epochs, batch, columns, replicas) -> tuple[PipelineModel, NetRegressor]:
    if isinstance(preset, str):
        preset, rounds = PRESETS[preset]
        epochs = epochs or rounds
    categories, numbers = feature_columns(preset, columns)
    prep = Pipeline(
        stages=[
            index_categories(categories, [f"ix{k}" for k in range(len(categories))]),
            Imputer(strategy="mean", inputCols=numbers, outputCols=[f"{c}_num" for c in numbers]),
            VectorAssembler(inputCols=[f"{c}_num" for c in numbers], outputCol="num_raw"),
            StandardScaler(inputCol="num_raw", outputCol="num_vec", withMean=True, withStd=True),
        ]
    ).fit(df.where(F.col(preset.response).isNotNull()))
    levels = [len(labels) + 1 for labels in prep.stages[0].labelsArray]
    net = NetRegressor(
        levels=levels, numbers=len(numbers), keyCols=[*categories, *numbers], hidden=list(hidden), maxIter=epochs or 1, batchSize=batch, replicas=replicas,
        seed=preset.seed, labelCol=preset.response,
    )
    return prep, net
