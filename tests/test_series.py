from __future__ import annotations

import numpy as np
import pytest

from zonecast.functions.special import f_sf
from zonecast.operators import series


def frame(spark, lengths, seed=0, gap=3):
    rng = np.random.default_rng(seed)
    data, rows = {}, []
    for key, n in lengths.items():
        t = np.cumsum(rng.integers(1, gap + 1, n))
        x, y = rng.normal(size=n), rng.normal(size=n)
        if n > 2:
            y[1:] += 0.7 * x[:-1]
        data[key] = (t, x, y)
        rows += [(key, int(a), float(b), float(c)) for a, b, c in zip(t, x, y, strict=True)]
    rng.shuffle(rows)
    rows = [(k, int(t), float(x), float(y)) for k, t, x, y in rows]
    return spark.createDataFrame(rows, "key string, t int, x double, y double"), data


def test_index(spark):
    df, data = frame(spark, {"a": 50, "b": 1, "c": 7})
    for r in series.series_index(df, "key", "t").collect():
        t = data[r.key][0]
        assert t[r.j] == r.t and r.n == len(t)


@pytest.mark.parametrize("width, lag", [(1, 1), (2, 5), (4, 3), (65_536, 2)])
def test_lags(spark, width, lag):
    df, data = frame(spark, {"a": 40, "b": 2, "c": 6}, seed=1)
    got = {}
    for r in series.lag_matrix(df, "key", "t", ["x", "y"], lag, width).collect():
        got[r.key, r.t] = tuple(r)[2:]
    want = {}
    for key, (t, x, y) in data.items():
        for j in range(lag, len(t)):
            lags = [v[j - k] for v in (x, y) for k in range(1, lag + 1)]
            want[key, t[j]] = (x[j], y[j], *lags, 1.0)
    assert got == want


def test_spectrum(spark):
    lengths = {"a": 144, "b": 1, "c": 2, "d": 64, "e": 33, "f": 7}
    df, data = frame(spark, lengths, seed=2)
    got = {}
    for r in series.power_spectrum(df, "key", "t", "y").collect():
        got.setdefault((r.key, r.padded), {})[r.bin] = (r.mag, r.psd)
    for key, n in lengths.items():
        p = 1 if n == 1 else 1 << (n - 1).bit_length()
        want = np.abs(np.fft.rfft(data[key][2], p)) if p > 1 else np.abs(data[key][2])
        bins = got[key, p]
        assert sorted(bins) == list(range(p // 2 + 1))
        np.testing.assert_allclose([bins[k][0] for k in sorted(bins)], want, atol=1e-10)
        np.testing.assert_allclose([bins[k][1] for k in sorted(bins)], want**2 / p, atol=1e-9)


def test_long_series_with_a_sparse_order(spark):
    """200,000 rows ten minutes apart in microseconds: in ranges of the order, however wide its steps."""
    n = 200_000
    df = spark.range(n).selectExpr("'k' AS key", "id * 600000000 AS t", "cos(id * 0.01) AS y")
    indexed = series.series_index(df, "key", "t").selectExpr("t = j * 600000000 AND n = 200000 AS ok", "j")
    assert indexed.where("ok").distinct().count() == n
    peak = series.spectrum(df, "key", "t", "y").orderBy("mag", ascending=False).first()
    assert peak.padded == 262_144 and peak.bin == round(0.01 / (2 * np.pi) * 262_144)


def test_padded_length(spark):
    ns = list(range(0, 70)) + [2**29, 2**29 + 1, 2**40 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", series.padded_len("n").alias("p"))
    for r in df.collect():
        assert r.p == (r.n if r.n < 2 else 1 << (r.n - 1).bit_length())


@pytest.mark.parametrize("lag", [1, 2, 4])
def test_granger(spark, lag):
    df, data = frame(spark, {"a": 120, "b": 60}, seed=3)
    for r in series.granger(df, "key", "t", "x", "y", lag, width=16).collect():
        _, x, y = data[r.key]
        n = len(y) - lag
        own = np.column_stack([np.ones(n)] + [y[lag - k : len(y) - k] for k in range(1, lag + 1)])
        both = np.column_stack([own] + [x[lag - k : len(x) - k] for k in range(1, lag + 1)])
        target = y[lag:]
        rss = [np.sum((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2) for m in (own, both)]
        f = ((rss[0] - rss[1]) / lag) / (rss[1] / (n - 2 * lag - 1))
        assert r.n == n
        assert r.f == pytest.approx(f, rel=1e-9)
        assert r.r2 == pytest.approx(1 - rss[1] / np.sum((target - target.mean()) ** 2), rel=1e-9)
        assert r.p == pytest.approx(float(f_sf(f, lag, n - 2 * lag - 1)), rel=1e-6, abs=1e-14)


def test_f_tail_against_numeric_integration():
    from math import exp, lgamma, log

    for d1, d2, f in [(1, 5, 2.3), (2, 30, 0.4), (4, 11, 3.1), (3, 200, 5.0)]:
        const = lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * log(d1 / d2)
        u = np.linspace(0.0, 1.0, 400_001)[1:-1]
        t = f + u / (1 - u)
        dens = np.exp(const + (d1 / 2 - 1) * np.log(t) - (d1 + d2) / 2 * np.log1p(d1 * t / d2))
        total = np.trapezoid(dens / (1 - u) ** 2, u)
        assert float(f_sf(f, d1, d2)) == pytest.approx(total, rel=1e-4)
    assert float(f_sf(0.0, 2, 9)) == 1.0
    assert float(f_sf(np.inf, 2, 9)) == 0.0
    assert np.isnan(f_sf(1.0, 2, 0))
    assert exp(0) == 1


def test_sums_of_squares_and_ols(spark):
    df, data = frame(spark, {"a": 30, "b": 12}, seed=4)
    for r in series.tss(df, "key", "y").collect():
        y = data[r.key][2]
        assert r.tss == pytest.approx(np.sum((y - y.mean()) ** 2))
    for r in series.rss(df, "key", "x").collect():
        assert r.rss == pytest.approx(np.sum(data[r.key][1] ** 2))
    for r in series.ols_by_key(df, "key", "y", ["x", "t"]).collect():
        t, x, y = data[r.key]
        m = np.column_stack([np.ones(len(y)), x, t])
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        np.testing.assert_allclose([r.intercept, *r.coef], beta, rtol=1e-8)
        assert r.rss == pytest.approx(np.sum((y - m @ beta) ** 2))


def test_ols_keeps_digits_of_nearly_collinear_columns(spark):
    """Columns near 10^6 that differ by thousandths: as exact as least squares on the whole matrix."""
    rng = np.random.default_rng(9)
    parts = {}
    for key, n in (("long", 3000), ("short", 12)):
        a = 1e6 + rng.normal(size=n)
        b = a + 1e-3 * rng.normal(size=n)
        parts[key] = a, b, 3 + 2 * a - b + 1e-3 * rng.normal(size=n)
    rows = [(k, *map(float, r)) for k, v in parts.items() for r in zip(*v, strict=True)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y double").repartition(7)
    for r in series.ols_by_key(df, "key", "y", ["a", "b"]).collect():
        a, b, y = parts[r.key]
        full = np.column_stack([np.ones(len(a)), a - a.mean(), b - b.mean()])
        want = np.linalg.lstsq(full, y - y.mean(), rcond=None)[0]
        assert r.n == len(a) and np.allclose(r.coef, want[1:], rtol=1e-6)
        assert r.rss == pytest.approx(np.sum((y - y.mean() - full @ want) ** 2), rel=1e-6)


def test_ols_defined_on_odd_series(spark):
    """A constant column takes no part, missing values drop their row, a constant y has no share explained."""
    rows = [("c", 7.1, float(t), 2.0 * t) for t in range(20)] + [("y", float(t), float(t * t), 0.3) for t in range(9)]
    rows += [("one", 1.0, 2.0, 3.0), ("c", None, 1.0, 5.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y double")
    got = {r.key: r for r in series.ols_by_key(df, "key", "y", ["a", "b"]).collect()}
    assert got["c"].n == 20 and got["c"].coef == pytest.approx([0.0, 2.0], abs=1e-12) and got["c"].intercept == pytest.approx(0, abs=1e-9)
    assert got["y"].coef == pytest.approx([0.0, 0.0]) and got["y"].r2 is None and got["y"].intercept == pytest.approx(0.3)
    assert got["one"].coef == pytest.approx([0.0, 0.0]) and got["one"].intercept == pytest.approx(3.0)
    assert got[None].n == 1
