"""T-3 .. T-6, X-4 and P-19 against plain loops."""

import datetime

import numpy as np
import pytest

from pyspark.sql import functions as F

from adlytics.operators.resample import replicate_arrays
from adlytics.operators.seasonal import Seasons, as_arrays, decompose_arrays
from adlytics.operators.smoothing import band, candidates, holt_winters, horizon, predicted
from adlytics.plans import forecast as plan

from conftest import SF_MID


def smooth(y, m, al, be, ga, ph):
    a, b = np.mean(y[:m]), (np.mean(y[m:2 * m]) - np.mean(y[:m])) / m
    ring = [y[i] - a - b * (i - (m - 1) / 2) for i in range(m)]
    level, slope, sse = a + b * (m - 1) / 2, b, 0.0
    for v in y[m:]:
        e, s = ph * slope, ring.pop(0)
        sse += (v - level - e - s) ** 2
        new = al * (v - s) + (1 - al) * (level + e)
        ring.append(ga * (v - level - e) + (1 - ga) * s)
        level, slope = new, be * (new - level) + (1 - be) * e
    return sse, level, slope, ring


@pytest.mark.parametrize("m", [2, 7])
def test_holt_winters_equals_a_loop(spark, m):
    r = np.random.default_rng(m)
    series = {k: (20 + 0.1 * np.arange(n) + 5 * np.sin(np.arange(n)) + r.normal(size=n)).tolist() for k, n in (("a", 60), ("b", 2 * m), ("short", 2 * m - 1))}
    df = spark.createDataFrame([(k, y) for k, y in series.items()], "series string, ys array<double>")
    fits = holt_winters(df, ["series"], m)
    got = {x.series: x for x in fits.collect()}
    assert set(got) == {"a", "b"}
    for k, x in got.items():
        best = min(((smooth(series[k], m, *c), c) for c in candidates()), key=lambda t: t[0][0])
        assert (x.alpha, x.beta, x.gamma, x.phi) == best[1]
        assert np.allclose([x.sse, x.level, x.slope, *x.ring], [*best[0][:3], *best[0][3]])
    day = datetime.date(2024, 2, 20)
    days = predicted(fits.withColumns({"first": F.lit(day), "last": F.lit(day + datetime.timedelta(9))}), ["series"], "first", "last", m)
    for k, x in got.items():
        want = [x.level + sum(x.phi ** i for i in range(1, h + 1)) * x.slope + x.ring[(h - 1) % m] for h in range(1, 11)]
        assert np.allclose([d.prediction for d in days.filter(F.col("series") == k).orderBy("date").collect()], want)


def test_horizons(spark):
    d = spark.createDataFrame([(datetime.date(2024, 2, 20),), (datetime.date(2023, 12, 31),)], "d date")
    rows = d.select(horizon(F.col("d")).alias("a"), horizon(F.col("d"), "month_start").alias("b")).collect()
    assert [(str(r.a.first), str(r.a.last), str(r.b.first)) for r in rows] == [
        ("2024-02-20", "2024-02-29", "2024-02-01"), ("2023-12-31", "2023-12-31", "2023-12-01")]


def parts(spark, residual, trend=10.0):
    n = len(residual)
    return spark.createDataFrame([("s", [trend + i for i in range(n)], [float(i % 3) for i in range(n)], residual)],
                                 "series string, trend array<double>, season array<double>, residual array<double>")


@pytest.mark.parametrize("blocks", [True, False])
def test_replicates_keep_trend_and_season(spark, blocks):
    residual = [1000.0 * (i + 1) for i in range(40)]
    rows = replicate_arrays(parts(spark, residual), ["series"], 6, seed=3, blocks=blocks).collect()
    assert sorted(r.rep for r in rows) == list(range(6)) and len({tuple(r.ys) for r in rows}) == 6
    b = int(40 ** 0.2) if blocks else 1
    for r in rows:
        drawn = [v - (10 + i) - i % 3 for i, v in enumerate(r.ys)]
        assert set(drawn) <= set(residual)
        src = [int(v / 1000) - 1 for v in drawn]
        assert all((src[i] - src[i - i % b]) % 40 == i % b for i in range(40))


def test_replicates_that_are_all_negative_go(spark):
    assert replicate_arrays(parts(spark, [0.0] * 20, trend=-500.0), ["series"], 4).count() == 0
    assert replicate_arrays(parts(spark, [0.0] * 20, trend=-10.0), ["series"], 4).count() == 4


def test_band(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 6)], "series string, p double")
    r = band(df, ["series"], "p").first()
    assert np.allclose([r["mean"], r.lower, r.upper], [3, 3 - np.std([1, 2, 6], ddof=1), 3 + np.std([1, 2, 6], ddof=1)])


def test_states_of_groups(spark, queries):
    """A short group is a row with its status, not a gap."""
    rows = queries["c27_forecast_groups"].run(spark, SF_MID).collect()
    states = {r.grp: r.status for r in rows}
    assert states["EUROPE"] == "ok" and "too few rows" in states.values()
    assert all((r.date is None) == (r.status != "ok") and (r.predicted_booking_revenues is None) == (r.status != "ok") for r in rows)


def test_one_plan_for_all_cut_offs(spark):
    """The sweep reads the facts once for the forecasts, once for the actuals."""
    from adlytics.plans.registry import views_for
    v = views_for(spark, SF_MID)
    plans = [plan.backtest(v, plan.CUTOFFS[:k])._jdf.queryExecution().executedPlan().toString().count("FileScan") for k in (1, 3)]
    assert plans[0] == plans[1]


def test_short_series_have_no_parts(spark):
    df = spark.createDataFrame([("s", i, 1.0) for i in range(13)], "series string, idx int, value double")
    assert decompose_arrays(as_arrays(df, ["series"]), Seasons(7, inner=1, outer=0)).count() == 0


def test_stationary_blocks(spark):
    """Days follow each other within a block, and blocks have the mean length asked for."""
    from adlytics.operators.resample import stationary_bootstrap
    n, reps, length = 400, 30, 7.0
    df = spark.createDataFrame([("s", i, float(i)) for i in range(n)], "series string, idx int, value double")
    rows = stationary_bootstrap(df, reps, length).orderBy("rep", "idx").collect()
    assert len(rows) == n * reps and all(r.value == r.src for r in rows)
    breaks = sum(1 for a, b in zip(rows, rows[1:]) if a.rep == b.rep and b.src != (a.src + 1) % n) + reps
    assert 0.8 * length < n * reps / breaks < 1.25 * length
    assert len({r.src for r in rows}) > 0.95 * n
