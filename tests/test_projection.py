"""Variable projection against a dense grid and known curves."""

import numpy as np
import pytest

from adlytics.operators.projection import projected_fit


def _shape(curve, x, u, v):
    if curve == "gauss":
        return np.exp(-(x - u) ** 2 / (2 * v * v))
    return 1 / (1 + np.exp(-np.clip(v * (x - u), -700, 700)))


def _ssr(curve, x, y, u, v):
    s = _shape(curve, x, u, v)
    a = np.stack([s, np.ones_like(s)], 1) if curve == "sigmoid" else s[:, None]
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    return float(((y - a @ beta) ** 2).sum())


TRUE = {"gauss": {"a": 50.0, "x0": 30.0, "sigma": 8.0}, "sigmoid": {"A": -40.0, "k": 0.3, "x0": 45.0, "offset": 70.0}}


@pytest.mark.parametrize("curve", ["gauss", "sigmoid"])
def test_projected_fit(spark, curve):
    r = np.random.default_rng(3)
    x = np.sort(r.uniform(0, 90, 80))
    t = TRUE[curve]
    wide = t["sigma"] if curve == "gauss" else t["k"]
    y = t.get("a", t.get("A")) * _shape(curve, x, t["x0"], wide) + t.get("offset", 0.0)
    noisy = y + r.normal(0, 3, len(x))
    rows = [("exact", float(a), float(b)) for a, b in zip(x, y)] + [(None, float(a), float(b)) for a, b in zip(x, noisy)]
    rows += [(None, 5.0, None), (None, None, 5.0), ("none", None, None), ("one", 1.0, 2.0), ("same", 4.0, 1.0), ("same", 4.0, 2.0)]
    rows += [("same", 4.0, 3.0), ("same", 4.0, 4.0)]
    rows += [("line", float(a), 2.0 * a) for a in range(30)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = {z.g: z for z in projected_fit(df, ["g"], "x", "y", curve).collect()}
    assert set(got) == {"exact", None, "none", "one", "same", "line"}
    for name in ("none", "one", "same"):
        assert got[name].status == "no_start" and got[name].x0 is None
    assert got["exact"].status == "converged" and got["exact"].n == len(x)
    for p, v in t.items():
        assert abs(got["exact"][p] - v) < 1e-3 * abs(v)
    fit = got[None]
    v = fit.sigma if curve == "gauss" else fit.k
    here = _ssr(curve, x, noisy, fit.x0, v)
    assert fit.status == "converged" and abs(fit.ssr - here) < 1e-6 * here
    # not above nearby points, nor above a dense grid
    for du in (-1e-3, 0, 1e-3):
        for dv in (-1e-3, 0, 1e-3):
            assert here <= _ssr(curve, x, noisy, fit.x0 * (1 + du), v * (1 + dv)) * (1 + 1e-9)
    span = np.geomspace(2, 300, 60) if curve == "gauss" else np.geomspace(0.012, 2, 60)
    assert here <= min(_ssr(curve, x, noisy, u, w) for u in np.linspace(-40, 130, 120) for w in span) + 1e-9
    assert got["line"].status in ("on_edge", "converged")


def test_bootstrap_refit(spark):
    """Many replicates at once give what each gives alone; the sd of a line
    comes near its closed form; unpaired draws lose the slope."""
    from adlytics.operators import curves as CV
    from adlytics.operators import refit as RF
    r = np.random.default_rng(8)
    rows = [(g, i, float(x), float(3 + b * x + r.normal(0, 2)))
            for g, b in (("up", 2.0), ("down", -1.0)) for i, x in enumerate(r.uniform(0, 10, 60))]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")
    closed = {z.g: z for z in CV.linear_fit(df, ["g"], "x", "y").collect()}
    for paired in (True, False):
        got = {z.g: z for z in RF.spread_of(RF.bootstrap_fit(df, "g", "t", "x", "y", "linear", 300, paired), "g", ["a", "b"]).collect()}
        for g, slope in (("up", 2.0), ("down", -1.0)):
            assert got[g].trials == got[g].fitted == 300 and got[g].b_lower < got[g].mean_b < got[g].b_upper
            if paired:
                assert 0.7 < got[g].sd_b / closed[g].se_b < 1.4 and abs(got[g].mean_b - slope) < 0.2
            else:
                assert got[g].b_lower < 0 < got[g].b_upper
    t = TRUE["sigmoid"]
    x = np.linspace(0, 90, 40)
    rows = [(g, i, float(a), float(t["A"] * _shape("sigmoid", a, t["x0"], t["k"]) + t["offset"] + r.normal(0, 1)))
            for g in ("p", "q") for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")
    fits = RF.bootstrap_fit(df, "g", "t", "x", "y", "sigmoid", 8)
    got = {(z.g, z.rep): z for z in fits.collect()}
    assert len(got) == 16
    sample = RF.bootstrap_pairs(df, "g", "t", "x", "y", 8).toPandas()
    for key in (("p", 0), ("q", 5)):
        one = sample[(sample.g == key[0]) & (sample.rep == key[1])]
        assert len(one) == 40
        here = _ssr("sigmoid", one.x.to_numpy(), one.y.to_numpy(), got[key].x0, got[key].k)
        assert abs(got[key].ssr - here) < 1e-6 * here
        grid = min(_ssr("sigmoid", one.x.to_numpy(), one.y.to_numpy(), u, w)
                   for u in np.linspace(20, 70, 60) for w in np.geomspace(0.05, 2, 60))
        assert here <= grid + 1e-9
    back = RF.spread_of(fits, "g", ["x0"]).collect()
    assert all(abs(z.mean_x0 - t["x0"]) < 2 and z.fitted == 8 for z in back)
