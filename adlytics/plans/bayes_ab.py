"""Bayesian verdict on the experiment readouts (C-34, B-1 .. B-14).

Two applications as in the analysis: bookings per user-day (from C-1) and
subscriptions per session (from C-2), control ``arm0`` vs variant ``arm1``,
prior Beta(1, 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.operators import bayes as B
from adlytics.operators.reshape import expand_trials
from adlytics.oracle.views import with_views
from adlytics.plans import experiment as X
from adlytics.plans.registry import register
from adlytics.sources.views import Views

E = F.col

CONTROL, VARIANT = "arm0", "arm1"
ALPHA, BETA = 1.0, 1.0
GRID = 20000
N_MC = 500000          # importance-sampling pairs per day, as in the original estimator
N_DRAWS = 5000         # posterior draws for the lift interval
EPS = 0.0001

BY_DAY_FLOATS = {"variant_expected_loss": 9, "control_expected_loss": 9, "prob_variant_better_than_control": 6,
                 "control_cvr": 9, "control_cvr_lower": 6, "control_cvr_upper": 6,
                 "variant_cvr": 9, "variant_cvr_lower": 6, "variant_cvr_upper": 6}


def bookings_daily(v: Views) -> DataFrame:
    k = X.daily_kpis(v)
    return B.daily_arms(k, "id", "dt", "users", "onsite_bookings", CONTROL, VARIANT)


def subscriptions_daily(v: Views) -> DataFrame:
    s = X.subscription_rate(v)
    return B.daily_arms(s, "id", "dt", "cookie_user_ids", "subscribers", CONTROL, VARIANT)


def bookings_by_day(v: Views) -> DataFrame:
    return B.bayes_by_day(bookings_daily(v), ALPHA, BETA, grid=GRID)


def subscriptions_by_day(v: Views) -> DataFrame:
    return B.bayes_by_day(subscriptions_daily(v), ALPHA, BETA, grid=GRID)


def _bayes_sql(daily_cte: str, n: str, k: str) -> str:
    """The same quadrature in DuckDB over a CTE ``d`` with (id, dt, n, k)."""
    return daily_cte + f"""
, arms AS (SELECT CASE WHEN id = '{CONTROL}' THEN 'control' ELSE 'variant' END AS arm, dt AS date,
                  sum({n}) AS n, sum({k}) AS k
           FROM d WHERE id IN ('{CONTROL}', '{VARIANT}') GROUP BY 1, 2)
, idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY arm ORDER BY date) - 1 AS INTEGER) AS day FROM arms)
, cum AS (SELECT *, sum(n) OVER w AS nn, sum(k) OVER w AS kk FROM idx
          WINDOW w AS (PARTITION BY arm ORDER BY day ROWS UNBOUNDED PRECEDING))
, post AS (
  SELECT c.day, c.date AS date_c, c.nn AS n_c, c.kk AS k_c, {ALPHA} + c.kk AS a_c, {BETA} + c.nn - c.kk AS b_c,
         v.nn AS n_v, v.kk AS k_v, {ALPHA} + v.kk AS a_v, {BETA} + v.nn - v.kk AS b_v
  FROM cum c JOIN cum v ON c.day = v.day AND c.arm = 'control' AND v.arm = 'variant')
, post2 AS (
  SELECT *, a_c / (a_c + b_c) AS mean_c, a_c * b_c / ((a_c + b_c) * (a_c + b_c) * (a_c + b_c + 1)) AS var_c,
         a_v / (a_v + b_v) AS mean_v, a_v * b_v / ((a_v + b_v) * (a_v + b_v) * (a_v + b_v + 1)) AS var_v
  FROM post)
, g AS (
  SELECT *, greatest(least(mean_c - 10 * sqrt(var_c), mean_v - 10 * sqrt(var_v)), 0.0) AS lo,
            least(greatest(mean_c + 10 * sqrt(var_c), mean_v + 10 * sqrt(var_v)), 1.0) AS hi
  FROM post2)
, p1 AS (SELECT day, lo, (hi - lo) / {GRID} AS h, a_c, b_c, a_v, b_v, unnest(range(0, {GRID})) AS i FROM g)
, p2 AS (SELECT *, lo + (i + 0.5) * h AS x FROM p1)
, p3 AS (SELECT *, (a_c - 1) * ln(x) + (b_c - 1) * ln(1 - x) AS lc, (a_v - 1) * ln(x) + (b_v - 1) * ln(1 - x) AS lv FROM p2)
, p5 AS (SELECT *, exp(lc - (lgamma(a_c) + lgamma(b_c) - lgamma(a_c + b_c))) * h AS pc,
                exp(lv - (lgamma(a_v) + lgamma(b_v) - lgamma(a_v + b_v))) * h AS pv FROM p3)
, p6 AS (SELECT *, sum(pc) OVER r AS ec, sum(pv) OVER r AS ev, sum(pc * x) OVER r AS sc, sum(pv * x) OVER r AS sv
         FROM p5 WINDOW r AS (PARTITION BY day ORDER BY i ROWS UNBOUNDED PRECEDING))
, p7 AS (SELECT *, ec - pc / 2 AS fc, ev - pv / 2 AS fv, sc - pc * x / 2 AS mc, sv - pv * x / 2 AS mv FROM p6)
, q AS (
  SELECT day, sum(pv * fc) / (sum(pc) * sum(pv)) AS prob_variant_better_than_control,
         sum(pv * (x * fc - mc)) / (sum(pc) * sum(pv)) AS control_expected_loss,
         sum(pc * (x * fv - mv)) / (sum(pc) * sum(pv)) AS variant_expected_loss,
         min(i) FILTER (WHERE ec >= 0.025) AS i_cl, min(i) FILTER (WHERE ec >= 0.975) AS i_cu,
         min(i) FILTER (WHERE ev >= 0.025) AS i_vl, min(i) FILTER (WHERE ev >= 0.975) AS i_vu
  FROM p7 GROUP BY day)
, byday AS (
  SELECT q.day, post2.date_c AS date, variant_expected_loss, control_expected_loss, prob_variant_better_than_control,
         post2.mean_c AS control_cvr,
         cl.lo + cl.i * cl.h + (0.025 - (cl.ec - cl.pc)) / cl.pc * cl.h AS control_cvr_lower,
         cu.lo + cu.i * cu.h + (0.975 - (cu.ec - cu.pc)) / cu.pc * cu.h AS control_cvr_upper,
         post2.mean_v AS variant_cvr,
         vl.lo + vl.i * vl.h + (0.025 - (vl.ev - vl.pv)) / vl.pv * vl.h AS variant_cvr_lower,
         vu.lo + vu.i * vu.h + (0.975 - (vu.ev - vu.pv)) / vu.pv * vu.h AS variant_cvr_upper,
         CAST(n_c AS BIGINT) AS control_sample_size, CAST(k_c AS BIGINT) AS control_conversions,
         CAST(n_v AS BIGINT) AS variant_sample_size, CAST(k_v AS BIGINT) AS variant_conversions
  FROM q JOIN post2 USING (day)
  JOIN p7 cl ON cl.day = q.day AND cl.i = q.i_cl
  JOIN p7 cu ON cu.day = q.day AND cu.i = q.i_cu
  JOIN p7 vl ON vl.day = q.day AND vl.i = q.i_vl
  JOIN p7 vu ON vu.day = q.day AND vu.i = q.i_vu)"""


_BOOKINGS_DAILY = f"""
, d AS (
  SELECT CAST(session_timestamp AS DATE) AS dt, id, count(DISTINCT cookie_user_id) AS users,
         sum(booking_quantity_direct_before_cancellations_onsite_booking) AS onsite_bookings
  FROM ab_sessions
  WHERE test_id = '{X.TEST_ID}' AND session_timestamp >= TIMESTAMP '{X.START}' AND device_type = '{X.DEVICE}'
  GROUP BY 1, 2)"""

_SUBS_DAILY = f"""
, a AS (SELECT * FROM ab_sessions WHERE test_id = '{X.TEST_ID}' AND session_timestamp >= TIMESTAMP '{X.START_LATE}'
        AND device_type = '{X.DEVICE}')
, d AS (
  SELECT a.id, CAST(a.session_timestamp AS DATE) AS dt, count(a.cookie_user_id) AS cookie_user_ids,
         count(CASE WHEN c.registration_date >= DATE '{X.START_LATE}' AND c.is_subscriber THEN c.uref END) AS subscribers
  FROM a LEFT JOIN sessions s ON a.session_id = s.session_id LEFT JOIN crm_users c ON s.uref = c.uref
  GROUP BY 1, 2)"""

register("c34_bayes_bookings_by_day", floats=BY_DAY_FLOATS, oracle=with_views(
    _bayes_sql(_BOOKINGS_DAILY, "users", "onsite_bookings") + "\nSELECT * FROM byday", "ab_sessions"),
    note="Beta posterior quadrature per day")(bookings_by_day)

register("c34_bayes_subscriptions_by_day", floats=BY_DAY_FLOATS, oracle=with_views(
    _bayes_sql(_SUBS_DAILY, "cookie_user_ids", "subscribers") + "\nSELECT * FROM byday",
    "ab_sessions", "sessions", "crm_users"))(subscriptions_by_day)


def bookings_first_safe_day(v: Views) -> DataFrame:
    return B.first_safe_day(bookings_by_day(v), EPS)


register("c34_bayes_first_safe_day", oracle=with_views(
    _bayes_sql(_BOOKINGS_DAILY, "users", "onsite_bookings") + f"""
SELECT min(day) FILTER (WHERE control_expected_loss < {EPS}) AS first_day_control_safe,
       min(day) FILTER (WHERE variant_expected_loss < {EPS}) AS first_day_variant_safe FROM byday""",
    "ab_sessions"))(bookings_first_safe_day)


_REPORT_SQL = """
, final AS (SELECT * FROM byday QUALIFY row_number() OVER (ORDER BY day DESC) = 1)
, lines AS (
  SELECT unnest([
    {'g': 'control', 'm': 'CvR', 'v': printf('%.5f', control_cvr)},
    {'g': 'control', 'm': 'sample size', 'v': CAST(control_sample_size AS VARCHAR)},
    {'g': 'control', 'm': 'conversions', 'v': CAST(control_conversions AS VARCHAR)},
    {'g': 'control', 'm': '95% credible interval', 'v': printf('(%.5f, %.5f)', control_cvr_lower, control_cvr_upper)},
    {'g': 'variant', 'm': 'CvR', 'v': printf('%.5f', variant_cvr)},
    {'g': 'variant', 'm': 'sample size', 'v': CAST(variant_sample_size AS VARCHAR)},
    {'g': 'variant', 'm': 'conversions', 'v': CAST(variant_conversions AS VARCHAR)},
    {'g': 'variant', 'm': '95% credible interval', 'v': printf('(%.5f, %.5f)', variant_cvr_lower, variant_cvr_upper)},
    {'g': 'outcome', 'm': 'uplift', 'v': printf('%.3f%%', (variant_cvr - control_cvr) / control_cvr * 100)},
    {'g': 'outcome', 'm': 'control expected loss', 'v': printf('%.8f', control_expected_loss)},
    {'g': 'outcome', 'm': 'variant expected loss', 'v': printf('%.8f', variant_expected_loss)},
    {'g': 'outcome', 'm': 'prob (variant >= control)', 'v': printf('%.3f%%', prob_variant_better_than_control * 100)}]) AS l
  FROM final)
SELECT l.g AS "group", l.m AS metric, l.v AS value FROM lines WHERE l.v IS NOT NULL"""


def bookings_verdict(v: Views) -> DataFrame:
    return B.verdict(bookings_by_day(v))


register("c34_bayes_verdict", oracle=with_views(
    _bayes_sql(_BOOKINGS_DAILY, "users", "onsite_bookings") + _REPORT_SQL, "ab_sessions"))(bookings_verdict)


def subscriptions_verdict(v: Views) -> DataFrame:
    return B.verdict(subscriptions_by_day(v))


register("c34_bayes_verdict_subscriptions", oracle=with_views(
    _bayes_sql(_SUBS_DAILY, "cookie_user_ids", "subscribers") + _REPORT_SQL, "ab_sessions", "sessions", "crm_users"))(subscriptions_verdict)


def bookings_importance_sampling(v: Views) -> DataFrame:
    post = B.posterior_params(bookings_daily(v), ALPHA, BETA)
    return B.importance_sampling(post, N_MC, simulations=1, seed=42)


register("c34_bayes_importance_sampling", note="sampler; checked against quadrature in tests")(
    bookings_importance_sampling)


def bookings_lift_hdi(v: Views) -> DataFrame:
    post = B.posterior_params(bookings_daily(v), ALPHA, BETA)
    draws = B.posterior_draws(post, N_DRAWS, GRID, seed=7)
    stats = draws.groupBy("day").agg(F.avg((E("v") >= E("c")).cast("double")).alias("share_variant_better"),
                                     F.avg("lift").alias("mean_lift"))
    return B.hdi(draws, "lift", ["day"], 0.05, N_DRAWS).join(stats, "day")


register("c34_bayes_lift_hdi", note="posterior draws; checked in tests")(bookings_lift_hdi)


def daily_cvr(v: Views) -> DataFrame:
    """B-11: daily conversion rate per arm (the plotted series)."""
    d = bookings_daily(v)
    return d.select("arm", "date", "day", "week_day", "n", "k", (E("k") / E("n")).alias("cvr"))


register("c34_daily_cvr", floats={"cvr": 6}, oracle=with_views(_BOOKINGS_DAILY + f"""
, arms AS (SELECT CASE WHEN id = '{CONTROL}' THEN 'control' ELSE 'variant' END AS arm, dt AS date,
                  CAST(sum(users) AS BIGINT) AS n, CAST(sum(onsite_bookings) AS BIGINT) AS k
           FROM d WHERE id IN ('{CONTROL}', '{VARIANT}') GROUP BY 1, 2)
SELECT arm, date, CAST(row_number() OVER (PARTITION BY arm ORDER BY date) - 1 AS INTEGER) AS day,
       dayname(date) AS week_day, n, k, k / n AS cvr
FROM arms""", "ab_sessions"))(daily_cvr)


def trial_moments(v: Views) -> DataFrame:
    """R-8: the arms' counts as single 0/1 trials, and their moments."""
    t = expand_trials(bookings_daily(v).select("arm", "n", "k"), "n", "k")
    return t.groupBy("arm").agg(F.count("trial").alias("trials"), F.sum("trial").alias("successes"),
                                F.avg("trial").alias("mean"), F.var_samp("trial").alias("variance"))


register("c34_trial_moments", floats={"mean": 6, "variance": 6}, oracle=with_views(_BOOKINGS_DAILY + f"""
, t AS (SELECT CASE WHEN id = '{CONTROL}' THEN 'control' ELSE 'variant' END AS arm, CAST(sum(users) AS BIGINT) AS trials,
               CAST(sum(onsite_bookings) AS BIGINT) AS successes
        FROM d WHERE id IN ('{CONTROL}', '{VARIANT}') GROUP BY 1)
SELECT arm, trials, successes, successes / trials AS mean,
       (successes - successes * successes / trials) / (trials - 1) AS variance FROM t""", "ab_sessions"))(trial_moments)
