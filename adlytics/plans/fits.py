"""Model fits of the analyses (C-13, C-21, C-23, C-35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlytics.functions.draws import sql_hash_int
from adlytics.operators import curves as CV
from adlytics.operators import projection as PJ
from adlytics.operators import refit as RF
from adlytics.operators import regress as RG
from adlytics.operators.windows import first_difference
from adlytics.oracle.views import with_views
from adlytics.plans import bidding as BD
from adlytics.plans import cases as CS
from adlytics.plans import delay as DL
from adlytics.plans import installs as I
from adlytics.plans import resampling as RS
from adlytics.plans.registry import register
from adlytics.sources.views import Views

E = F.col


# -------------------------------------------------------------------- C-13
def strategy_curves(v: Views) -> DataFrame:
    """Cost -> conversion value power curve exp(a) x^b per strategy type,
    parameters bounded to [0, 1], started at the upper corner; ``on_bound``
    tells when the best point lies on the box."""
    d = BD.with_strategy(v).select("bidding_strategy_type", "mkt_cost", "conversions_value")
    p0 = d.select("bidding_strategy_type").distinct().withColumns({"a": F.lit(1.0), "b": F.lit(1.0)})
    return CV.lm_fit(d, ["bidding_strategy_type"], "mkt_cost", "conversions_value", "power", p0, bounds=(0.0, 1.0))


register("c13_strategy_curves", note="nonlinear least squares; checked in tests")(strategy_curves)


# -------------------------------------------------------------------- C-21
def _split(v: Views) -> DataFrame:
    return RS.holdout(v).withColumns({"paid": E("paid").cast("double"), "organic": E("organic").cast("double")})


def _scored(v: Views, params: DataFrame, curve: str) -> DataFrame:
    test = _split(v).filter(E("is_test"))
    pred = CV.predict(test, params, ["platform"], "paid", curve)
    return params.join(CV.score(pred, ["platform"], "organic", "pred"), "platform")


def fit_linear(v: Views) -> DataFrame:
    train = _split(v).filter(~E("is_test"))
    p = CV.linear_fit(train, ["platform"], "paid", "organic")
    return _scored(v, p, "linear")


# train / test rows of the hold-out split, as x04
_SPLIT_SQL = I._PO_SQL + f"""
, hs AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY
                    {sql_hash_int('42', 'platform', "strftime(dt, '%Y-%m-%d')")}, strftime(dt, '%Y-%m-%d')) AS r,
                count(*) OVER (PARTITION BY platform) AS nn FROM po)
, sp AS (SELECT platform, dt, CAST(paid AS DOUBLE) AS x, CAST(organic AS DOUBLE) AS y, r <= ceil(nn * 0.15) AS is_test FROM hs)
, tr AS (SELECT * FROM sp WHERE NOT is_test)"""


def _score_sql(params: str, value: str) -> str:
    """R2 and RMSE of ``value`` (of x and the parameters) on the test rows."""
    return f"""
, sc AS (SELECT sp.platform, 1 - sum((y - ({value})) ^ 2) / (sum(y * y) - sum(y) ^ 2 / count(*)) AS r2,
                sqrt(avg((y - ({value})) ^ 2)) AS rmse
         FROM sp JOIN {params} USING (platform) WHERE is_test GROUP BY 1)
SELECT * FROM {params} JOIN sc USING (platform)"""


_LIN_FLOATS = {c: 6 for c in ("a", "b", "se_a", "se_b", "a_lower", "a_upper", "b_lower", "b_upper", "r2", "rmse")}
register("c21_fit_linear", floats=_LIN_FLOATS, oracle=with_views(I._PO_SQL + f"""
, hs AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY
                    {sql_hash_int('42', 'platform', "strftime(dt, '%Y-%m-%d')")}, strftime(dt, '%Y-%m-%d')) AS r,
                count(*) OVER (PARTITION BY platform) AS nn FROM po)
, sp AS (SELECT platform, CAST(paid AS DOUBLE) AS x, CAST(organic AS DOUBLE) AS y, r <= ceil(nn * 0.15) AS is_test FROM hs)
, f AS (
  SELECT platform, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy,
         regr_slope(y, x) AS b, regr_intercept(y, x) AS a
  FROM sp WHERE NOT is_test GROUP BY 1)
, f2 AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM f)
, f3 AS (SELECT *, sqrt(s2 / sxx) AS se_b, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se_a FROM f2)
, sc AS (
  SELECT sp.platform, 1 - sum((y - (a + b * x)) ^ 2) / (sum(y * y) - sum(y) ^ 2 / count(*)) AS r2,
         sqrt(avg((y - (a + b * x)) ^ 2)) AS rmse
  FROM sp JOIN f3 USING (platform) WHERE is_test GROUP BY 1)
SELECT platform, n, a, b, se_a, se_b, a - 1.96 * se_a AS a_lower, a + 1.96 * se_a AS a_upper,
       b - 1.96 * se_b AS b_lower, b + 1.96 * se_b AS b_upper, r2, rmse
FROM f3 JOIN sc USING (platform)""", "installs"))(fit_linear)


def linear_band(v: Views) -> DataFrame:
    """M-14 with the 95 % parameter bounds: the line and the lines of the
    lower and upper parameters on 50 points over the training range."""
    train = _split(v).filter(~E("is_test"))
    p = CV.linear_fit(train, ["platform"], "paid", "organic")
    b = train.groupBy("platform").agg(F.min("paid").alias("lo"), F.max("paid").alias("hi"))
    g = CV.curve_grid(b, p, ["platform"], "linear")
    lo = p.select("platform", E("a_lower").alias("a"), E("b_lower").alias("b"))
    hi = p.select("platform", E("a_upper").alias("a"), E("b_upper").alias("b"))
    g = CV.predict(g, lo, ["platform"], "x", "linear", "y_lower")
    g = CV.predict(g, hi, ["platform"], "x", "linear", "y_upper")
    return g.select("platform", "i", "x", "y", "y_lower", "y_upper")


register("c21_linear_band", floats={"x": 6, "y": 6, "y_lower": 6, "y_upper": 6}, oracle=with_views(_SPLIT_SQL + """
, f AS (SELECT platform, min(x) AS lo, max(x) AS hi, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
               regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_sxy(y, x) ^ 2 / regr_sxx(y, x)) / (count(*) - 2) AS s2
        FROM tr GROUP BY 1)
, e AS (SELECT *, 1.96 * sqrt(s2 / sxx) AS db, 1.96 * sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS da FROM f)
, g AS (SELECT *, CAST(unnest(range(0, 50)) AS INTEGER) AS i FROM e)
, gx AS (SELECT *, lo + (hi - lo) * i / 49 AS x FROM g)
SELECT platform, i, x, a + b * x AS y, (a - da) + (b - db) * x AS y_lower, (a + da) + (b + db) * x AS y_upper FROM gx""",
    "installs"))(linear_band)


def fit_polynomial(v: Views) -> DataFrame:
    train = _split(v).filter(~E("is_test"))
    return _scored(v, CV.quadratic_fit(train, ["platform"], "paid", "organic"), "polynomial")


# on centred x the quadratic is a regression on u and on the part of u^2 that u and 1 do not explain
register("c21_fit_polynomial", floats={"a": 6, "b": 5, "c": 4, "r2": 5, "rmse": 5}, oracle=with_views(_SPLIT_SQL + """
, m AS (SELECT platform, avg(x) AS m FROM tr GROUP BY 1)
, u AS (SELECT platform, m, x - m AS u, y FROM tr JOIN m USING (platform))
, lin AS (SELECT platform, regr_slope(u * u, u) AS g1, regr_intercept(u * u, u) AS g0, regr_slope(y, u) AS h1, regr_intercept(y, u) AS h0
          FROM u GROUP BY 1)
, q AS (SELECT platform, any_value(m) AS m, any_value(g0) AS g0, any_value(g1) AS g1, any_value(h0) AS h0, any_value(h1) AS h1,
               sum((u * u - g0 - g1 * u) * y) / sum((u * u - g0 - g1 * u) ^ 2) AS a
        FROM u JOIN lin USING (platform) GROUP BY 1)
, p AS (SELECT platform, a, (h1 - a * g1) - 2 * a * m AS b, a * m * m - (h1 - a * g1) * m + (h0 - a * g0) AS c FROM q)"""
    + _score_sql("p", "a * x * x + b * x + c"), "installs"))(fit_polynomial)


def fit_logarithm(v: Views) -> DataFrame:
    train = _split(v).filter(~E("is_test"))
    return _scored(v, CV.log_fit(train, ["platform"], "paid", "organic", c=1.0, d=5.0), "logarithm")


register("c21_fit_logarithm", floats={"a": 6, "b": 6, "c": 6, "d": 6, "r2": 6, "rmse": 6}, oracle=with_views(_SPLIT_SQL + """
, p AS (SELECT platform, regr_intercept(y, ln(x)) AS a, regr_slope(y, ln(x)) * ln(5.0) AS b, CAST(1.0 AS DOUBLE) AS c, CAST(5.0 AS DOUBLE) AS d
        FROM tr WHERE x > 0 GROUP BY 1)""" + _score_sql("p", "a + b * ln(CASE WHEN x > 0 THEN x * c END) / ln(d)"), "installs"))(fit_logarithm)


def _projected(v: Views, curve: str) -> DataFrame:
    """The curve by variable projection, with the parameters' sd at that point.  ``status``
    tells whether the data determine the curve (``on_edge``: they do not)."""
    train = _split(v).filter(~E("is_test"))
    p = PJ.projected_fit(train, ["platform"], "paid", "organic", curve)
    sd = CV.lm_fit(train, ["platform"], "paid", "organic", curve, p, max_iter=1)
    sd = sd.select("platform", *[c for c in sd.columns if c.startswith("sd_")])
    p = p.join(sd, "platform").withColumn("on_bound", E("status") == "on_edge")
    return _scored(v, p, curve)


def fit_gauss(v: Views) -> DataFrame:
    """Centre and width searched within the box of the training range, height solved."""
    return _projected(v, "gauss")


register("c21_fit_gauss", note="nonlinear least squares; checked in tests")(fit_gauss)


def fit_sigmoid(v: Views) -> DataFrame:
    """Centre and slope searched within the box of the training range, height and offset solved."""
    return _projected(v, "sigmoid")


register("c21_fit_sigmoid", note="nonlinear least squares; checked in tests")(fit_sigmoid)


# -------------------------------------------------------------------- C-23
def _diffed_cases(v: Views) -> DataFrame:
    d = CS.cases_vs_bookings(v).withColumn(
        "onsite_bookings_without_paym", E("onsite_bookings") - E("onsite_bookings_with_payment"))
    cols = ["onsite_bookings_with_payment", "onsite_bookings", "onsite_bookings_without_paym", "cases"]
    # weekly table (one row per week): a global order is a small window
    return first_difference(d, "dt", cols).filter(E("cases").isNotNull())


DESIGNS = {1: ["onsite_bookings_with_payment", "onsite_bookings"],
           2: ["onsite_bookings_with_payment", "onsite_bookings_without_paym"],
           3: ["onsite_bookings"]}


def cases_regressions(v: Views) -> DataFrame:
    """Gaussian GLMs of the weekly first differences, three designs."""
    d = _diffed_cases(v)
    out = None
    for k, xs in DESIGNS.items():
        t = RG.glm(d, "cases", xs, "gaussian").withColumn("design", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


register("c23_cases_regressions", note="GLM; checked in tests against least squares")(cases_regressions)


def cases_differences(v: Views) -> DataFrame:
    return _diffed_cases(v)


register("c23_cases_differences", oracle=with_views(CS._CASES_SQL + """
, j AS (SELECT *, onsite_bookings - onsite_bookings_with_payment AS onsite_bookings_without_paym FROM weeks)
SELECT * FROM (
SELECT dt,
       onsite_bookings_with_payment - lag(onsite_bookings_with_payment) OVER w AS onsite_bookings_with_payment,
       onsite_bookings - lag(onsite_bookings) OVER w AS onsite_bookings,
       cases - lag(cases) OVER w AS cases,
       onsite_bookings_without_paym - lag(onsite_bookings_without_paym) OVER w AS onsite_bookings_without_paym
FROM j
WINDOW w AS (ORDER BY dt)) q WHERE cases IS NOT NULL""", "cases", "conversions"))(cases_differences)


# -------------------------------------------------------------------- C-35
WARMUP_ROWS = 5        # default for the 30 days of the given events; 50 is usual for a history of three years
CHOW_SPLITS = [(9, 10), (14, 15), (19, 20), (4, 5), (24, 25)]


def delay_frame(v: Views) -> DataFrame:
    """The daily delay table with log revenue, revenue per click and the
    row index (the position used as regressor by the break test)."""
    d = DL.delay_daily(v)
    d = RG.with_index(d, "dt")
    return d.withColumns({"log_rev": RG.safe_ln(E("revenue")),
                          "rev_per_click": E("revenue") / E("clicks")})


def delay_chow(v: Views, splits: list[tuple[int, int]] = CHOW_SPLITS) -> DataFrame:
    """M-4: break tests of log revenue on the day index at the split points."""
    d = delay_frame(v).filter(E("log_rev").isNotNull())
    return RG.chow_test(d, "idx", "log_rev", splits)


_CHOW_FLOATS = {"rss_pooled": 6, "rss_before": 6, "rss_after": 6, "f_stat": 6}


def _chow_sql() -> str:
    arms = " UNION ALL ".join(f"SELECT {a} AS last_index, {b} AS first_index" for a, b in CHOW_SPLITS)
    parts = {"p": "TRUE", "1": "x <= last_index", "2": "x >= first_index"}
    aggs = []
    for nm, c in parts.items():
        aggs += [f"count(*) FILTER (WHERE {c}) AS n{nm}", f"sum(x) FILTER (WHERE {c}) AS sx{nm}",
                 f"sum(y) FILTER (WHERE {c}) AS sy{nm}", f"sum(x * x) FILTER (WHERE {c}) AS sxx{nm}",
                 f"sum(x * y) FILTER (WHERE {c}) AS sxy{nm}", f"sum(y * y) FILTER (WHERE {c}) AS syy{nm}"]
    rss = ", ".join(
        f"(syy{nm} - sy{nm} * sy{nm} / n{nm}) - (sxy{nm} - sx{nm} * sy{nm} / n{nm}) ^ 2 / (sxx{nm} - sx{nm} * sx{nm} / n{nm}) AS rss_{nm}"
        for nm in parts)
    return DL._DELAY_SQL.format(allowance=DL.ALLOWANCE_DAILY) + f"""
, dd AS (SELECT * FROM gaps_filled FULL JOIN ads USING (dt) WHERE dt < DATE '{DL.AS_OF}')
, ix AS (SELECT CAST(row_number() OVER (ORDER BY dt) - 1 AS DOUBLE) AS x, ln(revenue) AS y FROM dd)
, pts AS (SELECT x, y FROM ix WHERE y IS NOT NULL)
, sp AS ({arms})
, s AS (SELECT last_index, first_index, {', '.join(aggs)} FROM pts, sp GROUP BY 1, 2)
, rr AS (SELECT *, {rss} FROM s)
SELECT last_index, first_index, n1 AS n_before, n2 AS n_after, rss_p AS rss_pooled, rss_1 AS rss_before,
       rss_2 AS rss_after,
       CASE WHEN (rss_1 + rss_2) / (n1 + n2 - 4) > 0
            THEN ((rss_p - (rss_1 + rss_2)) / 2.0) / ((rss_1 + rss_2) / CAST(n1 + n2 - 4 AS DOUBLE)) END AS f_stat,
       CAST(2.0 AS DOUBLE) AS df1, CAST(n1 + n2 - 4 AS DOUBLE) AS df2
FROM rr"""


register("c35_delay_chow", floats=_CHOW_FLOATS,
         oracle=with_views(_chow_sql(), "uploads", "ads_report"))(delay_chow)


def delay_chow_significance(v: Views) -> DataFrame:
    return RG.chow_significance(delay_chow(v), 0.05)


register("c35_delay_chow_significance", floats={**_CHOW_FLOATS, "p_value": 6}, oracle=with_views(f"""{_chow_sql()[:_chow_sql().rindex("SELECT last_index, first_index, n1")]}
, chow AS ({_chow_sql()[_chow_sql().rindex("SELECT last_index, first_index, n1"):]})
SELECT *, (1 + 2 * f_stat / df2) ^ (-df2 / 2) AS p_value, (1 + 2 * f_stat / df2) ^ (-df2 / 2) < 0.05 AS reject_no_break FROM chow""",
    "uploads", "ads_report"))(delay_chow_significance)


def delay_glm(v: Views, warmup_rows: int = WARMUP_ROWS) -> DataFrame:
    """M-2: Gamma GLM (inverse link) of revenue per click on delay, clicks
    and spend, after the warm-up rows; missing values 0 as in the original,
    then rows with a non-positive response are left out (Gamma support)."""
    d = delay_frame(v).na.fill(0, ["delay", "clicks", "spend", "revenue", "rev_per_click"])
    d = d.filter(E("idx") >= warmup_rows).filter(E("rev_per_click") > 0)
    return RG.glm(d, "rev_per_click", ["delay", "clicks", "spend"], "gamma", "inverse")


register("c35_delay_glm", note="Gamma GLM; checked in tests")(delay_glm)


def weekly_design(v: Views) -> DataFrame:
    """M-3: the weekly lagged design (delay lags 1, 2, 4, 8, logs, ratios)."""
    w = DL.delay_weekly(v)
    w = RG.lagged(w, "week", "delay_in_week", [1, 2, 4, 8])
    return w.withColumns({"log_clicks": RG.safe_ln(E("clicks").cast("double")), "log_spend": RG.safe_ln(E("spend")),
                          "rev_per_click": E("revenue") / E("clicks").cast("double"),
                          "rev_per_spend": E("revenue") / E("spend")})


register("c35_weekly_design", floats={"spend": 4, "revenue": 4, "log_clicks": 6, "log_spend": 6,
                                      "rev_per_click": 6, "rev_per_spend": 6},
         oracle=with_views(DL._DELAY_SQL.format(allowance=DL.ALLOWANCE_WEEKLY) + f"""
, f AS (
  SELECT CAST(date_trunc('week', dt) AS DATE) AS week,
         CASE WHEN sum(delay) > 0 THEN 1 ELSE 0 END AS delay_in_week,
         sum(spend) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks, sum(revenue) AS revenue
  FROM gaps_filled FULL JOIN ads USING (dt) GROUP BY ALL)
, g AS (SELECT * FROM f WHERE week < DATE '{DL.AS_OF}')
SELECT *, lag(delay_in_week, 1) OVER w AS delay_in_week_lag1, lag(delay_in_week, 2) OVER w AS delay_in_week_lag2,
       lag(delay_in_week, 4) OVER w AS delay_in_week_lag4, lag(delay_in_week, 8) OVER w AS delay_in_week_lag8,
       CASE WHEN clicks > 0 THEN ln(CAST(clicks AS DOUBLE)) END AS log_clicks,
       CASE WHEN spend > 0 THEN ln(spend) END AS log_spend,
       revenue / CAST(clicks AS DOUBLE) AS rev_per_click, revenue / spend AS rev_per_spend
FROM g WINDOW w AS (ORDER BY week)""", "uploads", "ads_report"))(weekly_design)


# ---------------------------------------------------------------- X-5, X-6
BOOT_TRIALS = 100


def bootstrap_linear_refit(v: Views, trials: int = BOOT_TRIALS) -> DataFrame:
    """X-6: refit the line on ``trials`` paired bootstrap samples of the
    training days (X-5 index draws, md5-seeded), one row per (platform,
    replicate); the replicate is just another grouping key of the closed
    form."""
    train = _split(v).filter(~E("is_test"))
    return RF.bootstrap_fit(train, "platform", "dt", "paid", "organic", "linear", trials).select("platform", "rep", "a", "b")


_REFIT_SQL = _SPLIT_SQL + f"""
, ix AS (SELECT platform, row_number() OVER (PARTITION BY platform ORDER BY dt) - 1 AS idx, x, y FROM tr)
, nn AS (SELECT platform, count(*) AS n FROM ix GROUP BY 1)
, dr AS (SELECT platform, rep, unnest(range(0, n)) AS i, n FROM (SELECT *, unnest(range(0, {BOOT_TRIALS})) AS rep FROM nn))
, pk AS (SELECT platform, rep, {sql_hash_int('11', 'platform', 'rep', 'i')} % n AS src FROM dr)
, refit AS (SELECT platform, CAST(rep AS INTEGER) AS rep, regr_intercept(y, x) AS a, regr_slope(y, x) AS b
            FROM pk JOIN ix ON ix.platform = pk.platform AND ix.idx = pk.src GROUP BY ALL)"""
_REFIT_SQL = _REFIT_SQL.replace("SELECT platform, CAST(rep", "SELECT pk.platform, CAST(rep")
register("c21_bootstrap_refit", floats={"a": 5, "b": 5},
         oracle=with_views(_REFIT_SQL + "\nSELECT platform, rep, a, b FROM refit", "installs"))(bootstrap_linear_refit)


def bootstrap_refit_summary(v: Views) -> DataFrame:
    r = bootstrap_linear_refit(v)
    return r.groupBy("platform").agg(F.avg("a").alias("mean_a"), F.stddev_samp("a").alias("sd_a"),
                                     F.avg("b").alias("mean_b"), F.stddev_samp("b").alias("sd_b"),
                                     F.count(F.lit(1)).alias("trials"))


register("c21_bootstrap_refit_summary", floats={"mean_a": 5, "sd_a": 5, "mean_b": 5, "sd_b": 5}, oracle=with_views(_REFIT_SQL + """
SELECT platform, avg(a) AS mean_a, stddev_samp(a) AS sd_a, avg(b) AS mean_b, stddev_samp(b) AS sd_b, count(*) AS trials
FROM refit GROUP BY 1""", "installs"))(bootstrap_refit_summary)


def bootstrap_unpaired(v: Views, trials: int = BOOT_TRIALS) -> DataFrame:
    """X-6, unpaired: x and y drawn on their own, mean, sd and 95 % bounds of the line."""
    train = _split(v).filter(~E("is_test"))
    r = RF.bootstrap_fit(train, "platform", "dt", "paid", "organic", "linear", trials, paired=False)
    return RF.spread_of(r, "platform", ["a", "b"])


register("c21_bootstrap_unpaired", floats={c: 5 for c in ("mean_a", "sd_a", "a_lower", "a_upper", "mean_b", "sd_b", "b_lower", "b_upper")},
         oracle=with_views(_SPLIT_SQL + f"""
, ix AS (SELECT platform, row_number() OVER (PARTITION BY platform ORDER BY dt) - 1 AS idx, x, y FROM tr)
, nn AS (SELECT platform, count(*) AS n FROM ix GROUP BY 1)
, dr AS (SELECT platform, rep, unnest(range(0, n)) AS i, n FROM (SELECT *, unnest(range(0, {BOOT_TRIALS})) AS rep FROM nn))
, pk AS (SELECT *, {sql_hash_int('11', 'platform', 'rep', 'i')} % n AS xi, {sql_hash_int('12', 'platform', 'rep', 'i')} % n AS yi FROM dr)
, refit AS (SELECT pk.platform, rep, regr_intercept(b.y, a.x) AS a, regr_slope(b.y, a.x) AS b
            FROM pk JOIN ix a ON a.platform = pk.platform AND a.idx = xi JOIN ix b ON b.platform = pk.platform AND b.idx = yi
            GROUP BY ALL)
SELECT platform, count(*) AS trials, count(*) AS fitted, avg(a) AS mean_a, stddev_samp(a) AS sd_a,
       quantile_cont(a, 0.025) AS a_lower, quantile_cont(a, 0.975) AS a_upper, avg(b) AS mean_b, stddev_samp(b) AS sd_b,
       quantile_cont(b, 0.025) AS b_lower, quantile_cont(b, 0.975) AS b_upper
FROM refit GROUP BY 1""", "installs"))(bootstrap_unpaired)


def bootstrap_refit_sigmoid(v: Views, trials: int = BOOT_TRIALS) -> DataFrame:
    """X-6 of a curve without a closed form: one row per (platform, replicate)."""
    train = _split(v).filter(~E("is_test"))
    return RF.bootstrap_fit(train, "platform", "dt", "paid", "organic", "sigmoid", trials)


register("c21_bootstrap_refit_sigmoid", note="variable projection; checked in tests")(bootstrap_refit_sigmoid)


# -------------------------------------------------------------------- T-10
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, WEEKLY_ORDER = 10, 3
INTERVAL_Z = 1.2816          # 80 % band


def _trend_design(v: Views) -> tuple[DataFrame, list[str]]:
    """Day-level design: scaled time, hinge terms at 25 candidate
    changepoints spread over the first 80 % of the history, yearly (order
    10) and weekly (order 3) Fourier terms."""
    import math
    d = delay_frame(v).filter(E("log_rev").isNotNull()).select("dt", E("log_rev").alias("y"))
    allw = Window.partitionBy()           # day-level table: one small partition
    d = d.withColumns({"_i": F.row_number().over(Window.orderBy("dt")) - 1, "_n": F.count(F.lit(1)).over(allw),
                       "_d0": F.min("dt").over(allw), "_d1": F.max("dt").over(allw)})
    d = d.withColumn("t", F.datediff("dt", "_d0") / F.greatest(F.datediff("_d1", "_d0"), F.lit(1)))
    feats = ["t"]
    h = F.floor(E("_n") * CHANGEPOINT_RANGE)
    for j in range(1, N_CHANGEPOINTS + 1):
        cj = F.round(F.lit(j) * (h - 1) / N_CHANGEPOINTS).cast("int")
        tj = F.first(F.when(E("_i") == cj, E("t")), ignorenulls=True).over(allw)
        d = d.withColumns({f"cp{j}_t": tj, f"cp{j}": F.greatest(E("t") - tj, F.lit(0.0))})
        feats.append(f"cp{j}")
    day = F.datediff("dt", F.lit("1970-01-01").cast("date")).cast("double")
    for name, period, order in (("yearly", 365.25, YEARLY_ORDER), ("weekly", 7.0, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            ang = 2 * math.pi * k * day / period
            d = d.withColumns({f"{name}_sin{k}": F.sin(ang), f"{name}_cos{k}": F.cos(ang)})
            feats += [f"{name}_sin{k}", f"{name}_cos{k}"]
    return d, feats


def _trend_model(v: Views):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d, feats = _trend_design(v)
    va = VectorAssembler(inputCols=feats, outputCol="_f")
    x = va.transform(d)
    model = LinearRegression(featuresCol="_f", labelCol="y", elasticNetParam=1.0, regParam=0.001,
                             standardization=True, maxIter=200).fit(x)
    return d, feats, x, model


def trend_forecast(v: Views) -> DataFrame:
    """T-10: fitted trend + seasonality of log revenue with an 80 % band
    from the residual spread (a lasso on hinge + Fourier features stands in
    for the Bayesian trend model of the original; same role, not equal)."""
    _, _, x, model = _trend_model(v)
    p = model.transform(x).withColumnRenamed("prediction", "yhat")
    sd = F.stddev_samp(E("y") - E("yhat")).over(Window.partitionBy())
    return p.select("dt", "y", "yhat", (E("yhat") - INTERVAL_Z * sd).alias("yhat_lower"),
                    (E("yhat") + INTERVAL_Z * sd).alias("yhat_upper"))


register("c35_trend_forecast", note="trend + changepoints model; checked in tests")(trend_forecast)


def trend_changepoints(v: Views) -> DataFrame:
    """Changepoint dates whose hinge coefficient is not zero."""
    d, feats, _, model = _trend_model(v)
    coefs = dict(zip(feats, model.coefficients.toArray().tolist()))
    rows = [(j, float(coefs[f"cp{j}"])) for j in range(1, N_CHANGEPOINTS + 1)]
    cdf = v.spark.createDataFrame(rows, "j int, delta double")
    cps = d.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), E(f"cp{j}_t").alias("t_cp"))
                                        for j in range(1, N_CHANGEPOINTS + 1)])).alias("c"),
                   "_d0", "_d1").select("c.j", "c.t_cp", "_d0", "_d1").distinct()
    cps = cps.withColumn("changepoint", F.date_add("_d0", F.round(E("t_cp") * F.datediff("_d1", "_d0")).cast("int")))
    return (cps.join(F.broadcast(cdf), "j").filter(F.abs("delta") > 1e-9)
               .select("j", "changepoint", "delta"))


register("c35_trend_changepoints", note="trend + changepoints model; checked in tests")(trend_changepoints)


def linear_residuals(v: Views) -> DataFrame:
    """M-16: residuals y - f(x) of the training days under the fitted line."""
    train = _split(v).filter(~E("is_test"))
    p = CV.linear_fit(train, ["platform"], "paid", "organic")
    r = CV.predict(train, p, ["platform"], "paid", "linear")
    return r.select("platform", "dt", "paid", "organic", (E("organic") - E("pred")).alias("residual"))


register("c21_linear_residuals", floats={"paid": 6, "organic": 6, "residual": 6}, oracle=with_views(I._PO_SQL + f"""
, hs AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY
                    {sql_hash_int('42', 'platform', "strftime(dt, '%Y-%m-%d')")}, strftime(dt, '%Y-%m-%d')) AS r,
                count(*) OVER (PARTITION BY platform) AS nn FROM po)
, tr AS (SELECT platform, dt, CAST(paid AS DOUBLE) AS paid, CAST(organic AS DOUBLE) AS organic FROM hs
         WHERE NOT (r <= ceil(nn * 0.15)))
, f AS (SELECT platform, avg(paid) AS mx, avg(organic) AS my, regr_sxy(organic, paid) / regr_sxx(organic, paid) AS b
        FROM tr GROUP BY 1)
SELECT platform, dt, paid, organic, organic - ((my - b * mx) + b * paid) AS residual FROM tr JOIN f USING (platform)""",
    "installs"))(linear_residuals)
