"""Model fits and samplers against numpy / known values."""

import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from adlytics.operators import curves as CV
from adlytics.operators import regress as RG

from conftest import SF_MID, SF_SMALL


def _curve_df(spark, f, xs, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    ys = f(xs) + rng.normal(0, noise, len(xs))
    return spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(xs, ys)], "g string, x double, y double")


def test_lm_recovers_sigmoid(spark):
    xs = np.linspace(0, 8, 80)
    d = _curve_df(spark, lambda x: 5 / (1 + np.exp(-1.5 * (x - 4))) + 2, xs)
    p0 = spark.createDataFrame([("g", 6.0, 1.0, 3.5, 1.5)], "g string, A double, k double, x0 double, offset double")
    r = CV.lm_fit(d, ["g"], "x", "y", "sigmoid", p0).first()
    assert abs(r.A - 5) < 1e-4 and abs(r.k - 1.5) < 1e-4 and abs(r.x0 - 4) < 1e-4 and abs(r.offset - 2) < 1e-4


def test_lm_recovers_gauss_and_power_box(spark):
    xs = np.linspace(1, 10, 60)
    d = _curve_df(spark, lambda x: 3 * np.exp(-(x - 5) ** 2 / (2 * 1.2 ** 2)), xs)
    p0 = spark.createDataFrame([("g", 1.0, 4.5, 1.5)], "g string, a double, x0 double, sigma double")
    r = CV.lm_fit(d, ["g"], "x", "y", "gauss", p0).first()
    assert abs(r.a - 3) < 1e-4 and abs(r.x0 - 5) < 1e-4 and abs(abs(r.sigma) - 1.2) < 1e-4
    d2 = _curve_df(spark, lambda x: np.exp(0.4) * x ** 0.7, xs)
    p1 = spark.createDataFrame([("g", 1.0, 1.0)], "g string, a double, b double")
    r2 = CV.lm_fit(d2, ["g"], "x", "y", "power", p1, bounds=(0.0, 1.0)).first()
    assert abs(r2.a - 0.4) < 1e-3 and abs(r2.b - 0.7) < 1e-3


def test_gaussian_glm_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 2))
    y = 1.5 + X @ np.array([2.0, -0.5]) + rng.normal(0, 0.1, 200)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "x1 double, x2 double, y double")
    t = {r.term: r.coef for r in RG.glm(d, "y", ["x1", "x2"]).collect()}
    beta = np.linalg.lstsq(np.column_stack([np.ones(200), X]), y, rcond=None)[0]
    assert np.allclose([t["const"], t["x1"], t["x2"]], beta, atol=1e-6)


def test_gamma_glm_recovers(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 3000)
    mu = 1 / (0.5 + 0.8 * x)
    y = rng.gamma(50, mu / 50)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    t = {r.term: r.coef for r in RG.glm(d, "y", ["x"], "gamma", "inverse").collect()}
    assert abs(t["const"] - 0.5) < 0.03 and abs(t["x"] - 0.8) < 0.06


def test_bayes_invariants_and_sampler(spark, queries):
    bd = queries["c34_bayes_bookings_by_day"].run(spark, SF_MID).toPandas().sort_values("day")
    assert ((bd.control_cvr_lower < bd.control_cvr) & (bd.control_cvr < bd.control_cvr_upper)).all()
    diff = (bd.control_expected_loss - bd.variant_expected_loss) - (bd.variant_cvr - bd.control_cvr)
    assert diff.abs().max() < 1e-5
    from adlytics.operators import bayes as B
    from adlytics.plans import bayes_ab as BA
    from adlytics.plans.registry import views_for
    post = B.posterior_params(BA.bookings_daily(views_for(spark, SF_MID))).filter("day >= 25")
    im = B.importance_sampling(post, 200000, seed=3).toPandas().sort_values("day")
    m = bd.merge(im, on="day", suffixes=("_q", "_s"))
    err = (m.prob_variant_better_than_control_q - m.prob_variant_better_than_control_s).abs()
    assert (err < 6 * m.prob_variant_better_control_error + 1e-3).all()


def test_verdict_long_table(spark, queries):
    v = queries["c34_bayes_verdict"].run(spark, SF_MID).toPandas()
    assert len(v) == 12 and set(v.group) == {"control", "variant", "outcome"}
    assert v[v.metric == "uplift"].value.iloc[0].endswith("%")


def test_replicates_are_partition_invariant(spark, queries):
    q = queries["x03_block_bootstrap"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = q.run(spark, SF_SMALL).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = q.run(spark, SF_SMALL).toPandas()
    key = ["series", "rep", "idx"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_rows_only_queries_run(spark, queries):
    fast = ["c13_strategy_curves", "c21_linear_band", "c21_fit_polynomial", "c21_fit_logarithm", "c21_fit_gauss",
            "c21_fit_sigmoid", "c23_cases_regressions", "c35_delay_chow_significance", "c35_delay_glm",
            "c34_bayes_verdict_subscriptions", "c34_bayes_lift_hdi"]
    for n in fast:
        df = queries[n].run(spark, SF_MID)
        assert df.count() > 0, n


def test_fits_against_numpy(spark, queries):
    from adlytics.plans import fits
    from adlytics.plans.registry import views_for
    tr = fits._split(views_for(spark, SF_MID)).filter("NOT is_test").toPandas()
    poly = queries["c21_fit_polynomial"].run(spark, SF_MID).toPandas().set_index("platform")
    for p, g in tr.groupby("platform"):
        a, b, c = np.polyfit(g.paid, g.organic, 2)
        assert np.allclose([poly.loc[p, "a"], poly.loc[p, "b"], poly.loc[p, "c"]], [a, b, c], rtol=1e-6, atol=1e-4)
    reg = queries["c23_cases_regressions"].run(spark, SF_MID).toPandas()
    d = fits._diffed_cases(views_for(spark, SF_MID)).toPandas().dropna()
    X = np.column_stack([np.ones(len(d)), d.onsite_bookings])
    beta = np.linalg.lstsq(X, d.cases.astype(float), rcond=None)[0]
    r3 = reg[reg.design == 3].set_index("term")
    assert np.allclose([r3.loc["const", "coef"], r3.loc["onsite_bookings", "coef"]], beta, atol=1e-6)


def test_report_reader_and_cleaning(spark, queries):
    from adlytics.sources import text
    from adlytics.plans import keywords
    from adlytics.plans.registry import views_for
    raw = views_for(spark, SF_SMALL).search_terms_raw.toPandas()
    d = tempfile.mkdtemp(prefix="adlytics-report-")
    path = os.path.join(d, "sem_de.csv")
    lines = ["Search terms report", "All time"] + ["\t".join(text.REPORT_COLUMNS)]
    lines += ["\t".join(str(x) for x in r) for r in raw.itertuples(index=False)]
    with open(path, "w", encoding="utf-16") as fh:
        fh.write("\n".join(lines) + "\n")
    back = text.read_report(spark, path)
    assert back.count() == len(raw)
    cleaned = keywords.clean_search_terms(back).toPandas().sort_values("search_term").reset_index(drop=True)
    direct = queries["c32_search_terms"].build(views_for(spark, SF_SMALL)).toPandas().sort_values("search_term").reset_index(drop=True)
    assert cleaned.search_term.tolist() == direct.search_term.tolist()
    assert np.allclose(cleaned.revenue, direct.revenue)
    out = os.path.join(d, "utf8")
    assert text.transcode_report(spark, path, out) == len(raw)


def test_bootstrap_refit_spread_matches_standard_error(spark, queries):
    b = queries["c21_bootstrap_refit_summary"].run(spark, SF_MID).toPandas().set_index("platform")
    f = queries["c21_fit_linear"].run(spark, SF_MID).toPandas().set_index("platform")
    assert (b.trials == 100).all()
    ratio = b.sd_b / f.se_b
    assert ((ratio > 0.5) & (ratio < 2.0)).all()


def test_trend_model(spark, queries):
    t = queries["c35_trend_forecast"].run(spark, SF_MID).toPandas()
    assert (t.yhat_lower < t.yhat).all() and (t.yhat < t.yhat_upper).all()
    resid = t.y - t.yhat
    assert resid.std() < t.y.std()
    cps = queries["c35_trend_changepoints"].run(spark, SF_MID).toPandas()
    assert len(cps) <= 25 and (cps.delta.abs() > 0).all()


def test_curve_fit_sorts_no_group(spark, monkeypatch):
    """Each step of the fit meets its few parameters by broadcast: a join by
    shuffle would bring all rows of a group, nulls too, into one task's sort."""
    from adlytics.operators.curves import lm_fit
    rows = [(g, float(x), float(np.exp(0.5) * x ** b)) for g, b in (("a", 0.4), ("b", 0.7), (None, 0.9)) for x in range(1, 40)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    p0 = spark.createDataFrame([(g, 1.0, 1.0) for g in ("a", "b", None)], "g string, a double, b double")
    plans, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    fit = lm_fit(d, ["g"], "x", "y", "power", p0, bounds=(0.0, 1.0))
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)
    got = {r.g: r for r in fit.collect()}
    assert all(got[g].status == "converged" and np.allclose([got[g].a, got[g].b], [0.5, b], atol=1e-5)
               for g, b in (("a", 0.4), ("b", 0.7), (None, 0.9)))
