"""Keyed series: index, lags, spectrum, regression and causality.

One key may hold most rows, so no step puts a whole series into one group: a
series is cut into ranges of its order column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import f_sf
from ..session import ship_package, stage

BLOCK = 65_536


def series_index(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add the 0-based position ``j`` of each row in its series, and the length ``n``.

    The rows are range-partitioned by (key, order) and written; a row's partition
    is then fixed, rows are numbered inside it, and offsets come from one count per
    partition and key.  So no window holds more of a series than one partition
    does, whatever values the order column holds.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = df.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id())
    placed = stage(placed, "series")
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        key,
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("n"),
    )
    pos = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1
    return (
        placed.withColumn("_p", pos)
        .join(counts, [key, "_part"])
        .withColumn("j", F.col("_start") + F.col("_p"))
        .drop("_part", "_p", "_start")
    )


def lag_names(cols: list[str], lag: int) -> list[str]:
    return [f"{c}_lag{i}" for c in cols for i in range(1, lag + 1)]


def lag_matrix(
    df: DataFrame, key: str, order: str, cols: list[str], lag: int, width: int = BLOCK
) -> DataFrame:
    """Rows ``lag..n-1`` of each series with ``lag`` earlier values of each column.

    The last ``lag`` rows of a block also travel to the next block, as context
    for its first lags.
    """
    width = max(width, lag)
    rows = series_index(df, key, order).select(key, order, *cols, "j")
    block = F.floor(F.col("j") / width)
    homes = F.when(F.col("j") % width >= width - lag, F.array(block, block + 1)).otherwise(
        F.array(block)
    )
    placed = rows.select("*", block.alias("_home"), F.explode(homes).alias("_block"))
    w = Window.partitionBy(key, "_block").orderBy("j")
    lags = {f"{c}_lag{i}": F.lag(c, i).over(w) for c in cols for i in range(1, lag + 1)}
    return (
        placed.withColumns(lags)
        .where((F.col("_home") == F.col("_block")) & (F.col("j") >= lag))
        .select(key, order, *cols, *lags)
        .withColumn("const", F.lit(1.0))
    )


# -- spectrum -----------------------------------------------------------------


def padded_len(n: Column | str) -> Column:
    """Smallest power of two >= n; 0 stays 0 and 1 stays 1."""
    n = F.col(n) if isinstance(n, str) else n
    n = n.cast("bigint")
    bits = F.length(F.bin(n - 1))
    return F.when(n <= 1, n).otherwise(F.pow(F.lit(2.0), bits).cast("bigint"))


def _transform(rows: DataFrame, key: str, size: str, into: str, keep: list[str]) -> DataFrame:
    """One Fourier transform per row over arrays of (at, re, im), of length ``size``; bins come out as ``into``."""
    key_type = rows.schema[key].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in keep)

    def run(batches):
        for pdf in batches:
            bins = []
            for n, at, re, im in zip(pdf[size], pdf["at"], pdf["re"], pdf["im"], strict=True):
                x = np.zeros(int(n), complex)
                x[np.asarray(at, dtype=int)] = np.asarray(re) + 1j * np.asarray(im)
                bins.append(np.fft.fft(x))
            out = pdf[[key, *keep]].copy()
            out["out_re"], out["out_im"] = [b.real for b in bins], [b.imag for b in bins]
            yield out

    done = rows.mapInPandas(run, f"`{key}` {key_type}, {longs}, out_re array<double>, out_im array<double>")
    pairs = F.arrays_zip("out_re", "out_im")
    return done.select(key, *keep, F.posexplode(pairs).alias(into, "z")).select(
        key, *keep, F.col(into).cast("bigint").alias(into), F.col("z.out_re").alias("re"), F.col("z.out_im").alias("im")
    )


def spectrum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, padded, bin, mag): magnitude of bins 0..P/2 of the zero-padded series.

    The transform of length P = P1 * P2 (both near sqrt P) in four steps: rows at
    positions ``j1 * P2 + j2`` are transformed over j1, turned by ``j2 * k1 / P``,
    and transformed over j2 into bins ``k1 + P1 * k2``.  That is P log P work in
    arrays of about sqrt P values, so a long series is spread over as many tasks.
    """
    rows = series_index(df, key, order).select(key, "n", "j", F.col(value).cast("double").alias("x"))
    log_p = F.log2(padded_len("n").cast("double")).cast("int")
    rows = rows.withColumn("p", padded_len("n")).withColumn(
        "p1", F.pow(F.lit(2.0), F.floor(log_p / 2)).cast("bigint")
    )
    rows = rows.withColumn("p2", (F.col("p") / F.col("p1")).cast("bigint"))

    def gathered(points: DataFrame, group: list[str], at: str) -> DataFrame:
        point = F.collect_list(F.struct(F.col(at).alias("at"), "re", "im"))
        lists = points.groupBy(key, *group).agg(point.alias("v"))
        return lists.select(key, *group, *(F.col(f"v.{c}").alias(c) for c in ("at", "re", "im")))

    keep = ["n", "p", "p1", "p2"]
    split = rows.select(
        key, *keep, (F.col("j") % F.col("p2")).alias("j2"), F.floor(F.col("j") / F.col("p2")).alias("j1"),
        F.col("x").alias("re"), F.lit(0.0).alias("im"),
    )
    first = _transform(gathered(split, [*keep, "j2"], "j1"), key, "p1", "k1", [*keep, "j2"])
    # Reduced to one turn first to stay accurate.
    angle = ((F.col("j2") * F.col("k1")) % F.col("p")).cast("double") / F.col("p") * F.lit(2.0 * np.pi)
    turned = first.withColumns(
        {
            "re": F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle),
            "im": F.col("im") * F.cos(angle) - F.col("re") * F.sin(angle),
        }
    )
    second = _transform(gathered(turned, [*keep, "k1"], "j2"), key, "p2", "k2", [*keep, "k1"])
    bins = second.withColumn("bin", F.col("k1") + F.col("p1") * F.col("k2")).where("bin <= p / 2")
    return bins.select(key, "n", F.col("p").alias("padded"), "bin", F.sqrt(F.expr("re * re + im * im")).alias("mag"))


def power_spectrum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Spectrum with ``psd`` = magnitude squared over padded length."""
    s = spectrum(df, key, order, value)
    return s.withColumn("psd", F.col("mag") * F.col("mag") / F.col("padded"))


# -- sums of squares ----------------------------------------------------------


def tss(df: DataFrame, key: str, y: str) -> DataFrame:
    """Sum of squares of y around its mean, per key."""
    return df.groupBy(key).agg((F.var_pop(y) * F.count(y)).alias("tss"))


def rss(df: DataFrame, key: str, resid: str) -> DataFrame:
    """Sum of squared residuals per key."""
    return df.groupBy(key).agg(F.sum(F.col(resid) * F.col(resid)).alias("rss"))


# -- regression ---------------------------------------------------------------


#: Keys whose triangles a task holds before it hands them on, and triangles that are merged at once.
HELD_KEYS, FAN = 4096, 256


def _triangle(stacked: np.ndarray) -> np.ndarray:
    """Upper triangle with the same products of columns; at most as many rows as columns."""
    return np.linalg.qr(stacked, mode="r")


def _triangles(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, n, tri) with one orthogonal triangle of [1, cols...] per key, row after row.

    Tasks factor their rows as they read them, and the triangles of a key are
    factored again in groups of at most ``FAN`` task numbers, then all together.
    Products of columns are never formed, so no digits are lost to them.  Rows
    that lack a value take no part.
    """
    ship_package(df.sparkSession)
    width = len(cols) + 1
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n long, tri array<double>"

    def frame(found: dict) -> pd.DataFrame:
        rows = [(k, n, t.ravel()) for k, (n, t) in found.items()]
        return pd.DataFrame(rows, columns=[key, "n", "tri"])

    def factor(batches):
        held: dict = {}
        for pdf in batches:
            codes, keys = pd.factorize(pdf[key], use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            values = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(dtype=float)])[order]
            cuts = np.cumsum(np.bincount(codes, minlength=len(keys)))[:-1]
            for k, rows in zip(keys, np.split(values, cuts), strict=True):
                n, before = held.get(k, (0, rows[:0]))
                held[k] = n + len(rows), _triangle(np.vstack([before, rows]))
            if len(held) >= HELD_KEYS:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def merge(batches):
        for pdf in batches:
            pdf["tri"] = [
                (parts[0] if len(parts) == 1 else _triangle(np.concatenate(list(parts)).reshape(-1, width)).ravel())
                for parts in pdf["tri"]
            ]
            yield pdf

    parts = df.na.drop(subset=cols).select(key, *cols).mapInPandas(factor, schema)
    gathered = [F.sum("n").alias("n"), F.collect_list("tri").alias("tri")]
    group = (F.spark_partition_id() / FAN).cast("int").alias("_group")
    some = parts.select("*", group).groupBy(key, "_group").agg(*gathered).drop("_group").mapInPandas(merge, schema)
    return some.groupBy(key).agg(*gathered).mapInPandas(merge, schema)


def _squares(flat: pd.Series, width: int) -> np.ndarray:
    """The triangles as square matrices; rows that a short series lacks are zero."""
    out = np.zeros((len(flat), width, width))
    for k, t in enumerate(flat):
        out[k].flat[: len(t)] = t
    return out


def _fit(tri: np.ndarray, regressors: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, residual and total sum of squares) of the last column on the given columns and a constant.

    What is left of a column beside the constant counts as zero where it is below
    the rounding of the column itself.
    """
    norms = np.sqrt((tri * tri).sum(axis=1))
    norms[norms == 0] = 1
    inner = tri[:, 1:] / norms[:, None, :]
    floor = 8 * tri.shape[1] * np.finfo(float).eps
    a, y = inner[:, :, regressors], inner[:, :, -1]
    y = np.where(np.sqrt((y * y).sum(axis=1, keepdims=True)) > floor, y, 0.0)
    u, sv, vt = np.linalg.svd(a, full_matrices=False)
    inverse = np.divide(1.0, sv, out=np.zeros_like(sv), where=sv > floor)
    beta = np.einsum("kji,kj,klj,kl->ki", vt, inverse, u, y, optimize=True)
    resid = y - np.einsum("kij,kj->ki", a, beta)
    scale = norms[:, -1]
    return beta * (scale[:, None] / norms[:, regressors]), (resid**2).sum(axis=1) * scale**2, (y**2).sum(axis=1) * scale**2


def ols_by_key(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """(key, n, intercept, coef ARRAY, rss, r2) of y on xs with an intercept, per key."""
    size = len(xs) + 2

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            tri = _squares(pdf["tri"], size)
            beta, resid, total = _fit(tri, list(range(1, size - 1)))
            head = tri[:, 0] / tri[:, :1, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = 1.0 - resid / total
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "n": pdf["n"],
                    "intercept": head[:, -1] - (beta * head[:, 1:-1]).sum(axis=1),
                    "coef": list(beta),
                    "rss": resid,
                    "r2": r2,
                }
            )

    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n long, intercept double, coef array<double>, rss double, r2 double"
    return _triangles(df, key, [*xs, y]).mapInPandas(solve, schema)


def granger(
    df: DataFrame, key: str, order: str, x: str, y: str, lag: int, width: int = BLOCK
) -> DataFrame:
    """Does x help to predict y?  (key, n, f, r2, p) per key.

    Compares y on its own ``lag`` earlier values with y on those and ``lag``
    earlier values of x, both with an intercept.  One triangle per key reaches the
    last step.
    """
    if lag < 1:
        raise ValueError("lag must be at least 1")
    own, other = lag_names([y], lag), lag_names([x], lag)
    lagged = lag_matrix(df, key, order, [x, y], lag, width)
    size = 2 * lag + 2

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            tri = _squares(pdf["tri"], size)
            _, rss0, _ = _fit(tri, list(range(1, lag + 1)))
            _, rss1, total = _fit(tri, list(range(1, size - 1)))
            free = pdf["n"].to_numpy(dtype=float) - 2 * lag - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                f = ((rss0 - rss1) / lag) / (rss1 / free)
                r2 = 1.0 - rss1 / total
            yield pd.DataFrame(
                {key: pdf[key], "n": pdf["n"], "f": f, "r2": r2, "p": f_sf(f, lag, free)}
            )

    key_type = df.schema[key].dataType.simpleString()
    return _triangles(lagged, key, [*own, *other, y]).mapInPandas(
        solve, f"`{key}` {key_type}, n long, f double, r2 double, p double"
    )
