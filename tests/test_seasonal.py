"""T-1 against a plain numpy version of the published procedure, and its properties."""

import numpy as np
import pytest

from adlytics.operators.seasonal import Seasons, decompose, running

from pyspark.sql import functions as F


def line(y, w, first, last, x, reach, n):
    j = np.arange(first, last + 1)
    far = np.abs(j - x) / max(reach, 1e-9)
    k = np.where(far <= 0.001, 1.0, np.where(far <= 0.999, (1 - far ** 3) ** 3, 0.0)) * w[first:last + 1]
    if k.sum() <= 0:
        return y[min(max(x, first), last)]
    k = k / k.sum()
    mean = (k * j).sum()
    var = (k * (j - mean) ** 2).sum()
    v = y[first:last + 1]
    slope = (k * (j - mean) * v).sum() / var if var > (0.001 * (n - 1)) ** 2 else 0.0
    return (k * v).sum() + slope * (x - mean)


def at(y, w, x, q):
    n = len(y)
    first = max(min(x - (q - 1) // 2, n - q), 0)
    last = min(first + q, n) - 1
    return line(y, w, first, last, x, max(x - first, last - x) + max((q - n) // 2, 0), n)


def loess(y, w, q, jump):
    n = len(y)
    knots = sorted({min(k, n - 1) for k in range(0, n + jump, jump)})
    return np.interp(np.arange(n), knots, [at(y, w, x, q) for x in knots])


def plain(y, s):
    y, n, p = np.array(y, float), len(y), s.period
    trend, weight = np.zeros(n), np.ones(n)
    for _ in range(s.outer + 1):
        if _:
            r = np.abs(y - trend - season)
            h = 6 * np.median(r)
            weight = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / max(h, 1e-300)) ** 2) ** 2, 0.0))
        for _ in range(s.inner):
            c = np.zeros(n + 2 * p)
            for k in range(p):
                sub, sw = (y - trend)[k::p], weight[k::p]
                c[k::p][:len(sub) + 2] = [at(sub, sw, x, s.season) for x in range(-1, len(sub) + 1)]
            m = c
            for width in (p, p, 3):
                m = np.convolve(m, np.ones(width) / width, "valid")
            low, wide = s.low_pass_window(), s.trend_window()
            season = c[p:p + n] - loess(m, np.ones(n), low, s.jump_of(low))
            trend = loess(y - season, weight, wide, s.jump_of(wide))
    return trend, season, weight


def made(n, p, seed, outliers=()):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    y = 50 + 0.3 * t + 10 * np.sin(2 * np.pi * t / p) + r.normal(size=n)
    for i in outliers:
        y[i] += 500
    return y.tolist()


def run(spark, series, s):
    df = spark.createDataFrame([(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "series string, idx int, value double")
    out = {}
    for r in decompose(df, ["series"], s).orderBy("series", "idx").collect():
        out.setdefault(r.series, []).append(r)
    return out


@pytest.mark.parametrize("s", [Seasons(7, 13, inner=1, outer=0, jump=1), Seasons(7, 5, inner=2, outer=3, jump=1), Seasons(12, 7, inner=1, outer=2)])
def test_equals_plain_version(spark, s):
    series = {"a": made(60, s.period, 1), "b": made(41, s.period, 2, outliers=[20, 33]), "flat": [5.0] * 40, "short": [1.0] * (2 * s.period - 1)}
    got = run(spark, series, s)
    assert set(got) == {"a", "b", "flat"}  # less than two periods: left out
    for k, rows in got.items():
        trend, season, weight = plain(series[k], s)
        assert np.allclose([r.trend for r in rows], trend, atol=1e-8), k
        assert np.allclose([r.season for r in rows], season, atol=1e-8), k
        if k != "flat":  # residuals of rounding size have no weights to compare
            assert np.allclose([r.weight for r in rows], weight, atol=1e-6), k
        assert np.allclose([r.trend + r.season + r.residual for r in rows], series[k], atol=1e-9)


def test_outliers_do_not_move_trend_and_season(spark):
    clean, bad = made(84, 7, 5), made(84, 7, 5, outliers=[30, 51])
    got = run(spark, {"clean": clean, "bad": bad}, Seasons(7, 13, inner=2, outer=6))
    moved = run(spark, {"bad": bad}, Seasons(7, 13, inner=2, outer=0))["bad"]
    off = max(abs(a.trend - b.trend) for a, b in zip(got["clean"], got["bad"]))
    assert off < 1.5 and max(abs(a.trend - b.trend) for a, b in zip(got["clean"], moved)) > 10
    assert got["bad"][30].weight == 0 and got["bad"][51].weight == 0 and got["bad"][30].residual > 400


def test_windows():
    s = Seasons()
    assert (s.trend_window(), s.low_pass_window()) == (619, 367)
    assert (Seasons(7, 7).trend_window(), Seasons(12).low_pass_window()) == (15, 13)


def test_running_sums(spark):
    for n in (1, 63, 64, 65, 200):
        got = spark.range(1).select(running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast("double"))).alias("r")).first()["r"]
        assert got == np.concatenate([[0], np.cumsum(np.arange(1.0, n + 1))]).tolist()
