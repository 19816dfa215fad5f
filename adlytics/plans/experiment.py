"""A/B experiment readouts (C-1 .. C-6).

Parameters mirror the analysis (test id, device, start dates); the stand-in
data covers January 2024, so the defaults fall inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.functions.compat import asc_last, day_of, safe_div
from adlytics.operators.windows import running
from adlytics.oracle.views import with_views
from adlytics.operators.reshape import melt
from adlytics.plans.registry import REGISTRY, register
from adlytics.sources.views import Views

E = F.col

TEST_ID = "exp1"
DEVICE = "Mobile"
START = "2024-01-01"        # readout start
START_LATE = "2024-01-08"   # start of the subscription analyses
ARMS = ("arm0", "arm1")
INSTALL_START = "2024-01-03"


def traffic(v: Views, start: str, test_id: str = TEST_ID, device: str = DEVICE) -> DataFrame:
    s = v.ab_sessions
    return s.filter((E("test_id") == test_id) & (E("session_timestamp") >= F.lit(start).cast("timestamp"))
                    & (E("device_type") == device))


# --------------------------------------------------------------------- C-1
def daily_kpis(v: Views, start: str = START, test_id: str = TEST_ID, device: str = DEVICE) -> DataFrame:
    """Daily KPIs per arm with running user-days, revenue, bookings, RPU.

    The five distinct counts are computed by staged plain aggregates
    (session -> user -> day) instead of one multi-distinct aggregate, so no
    row is multiplied by an Expand and every stage combines map-side.
    """
    s = traffic(v, start, test_id, device).select(
        day_of("session_timestamp").alias("dt"), "id", "cookie_user_id", "session_id",
        (E("visitor_group") == "Returning Visitor").alias("ret"),
        "revenue", E("booking_quantity_direct_before_cancellations_onsite_booking").alias("bk"), "searches")
    per_session = s.groupBy("dt", "id", "cookie_user_id", "session_id").agg(
        F.max("ret").alias("ret"), F.sum("revenue").alias("revenue"), F.sum("bk").alias("bk"),
        F.max(E("bk") > 0).alias("has_bk"), F.sum("searches").alias("searches"))
    per_user = per_session.groupBy("dt", "id", "cookie_user_id").agg(
        F.max("ret").alias("ret_user"), F.count(F.lit(1)).alias("n_sessions"),
        F.count_if("ret").alias("n_ret_sessions"), F.sum("revenue").alias("revenue"),
        F.sum("bk").alias("bk"), F.max("has_bk").alias("has_bk"), F.sum("searches").alias("searches"))
    daily = per_user.groupBy("dt", "id").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("ret_user").alias("returning_users"),
        F.sum("n_sessions").alias("sessions"),
        F.sum("n_ret_sessions").alias("returning_sessions"),
        F.sum("revenue").alias("revenues"),
        F.sum("bk").alias("onsite_bookings"),
        F.sum("searches").alias("searches"),
        F.count_if("has_bk").alias("uwob"),
    )
    out = running(daily, ["id"], "dt", {"cum_users": "users", "cum_revenues": "revenues",
                                        "cum_onsite_bookings": "onsite_bookings", "cum_uwob": "uwob"})
    return out.select(
        "dt", "id", "users", "returning_users",
        safe_div("returning_users", "users").alias("returning_users_share"),
        "sessions", "returning_sessions",
        safe_div("returning_sessions", "sessions").alias("returning_sessions_share"),
        "revenues", "onsite_bookings", "searches", "uwob",
        "cum_users", "cum_revenues", "cum_onsite_bookings", "cum_uwob",
        safe_div("cum_revenues", "cum_users").alias("rpu"),
        safe_div("cum_onsite_bookings", "cum_users").alias("onsite_booking_per_user"),
    )


def _traffic_sql(start: str) -> str:
    return (f"SELECT * FROM ab_sessions WHERE test_id = '{TEST_ID}' AND session_timestamp >= TIMESTAMP '{start}'"
            f" AND device_type = '{DEVICE}'")


register("c01_daily_kpis", floats={"returning_users_share": 6, "returning_sessions_share": 6, "revenues": 4,
                                   "cum_revenues": 4, "rpu": 6, "onsite_booking_per_user": 6},
         oracle=with_views(f"""
, d AS (
  SELECT CAST(session_timestamp AS DATE) AS dt, id,
         count(DISTINCT cookie_user_id) AS users,
         count(DISTINCT CASE WHEN visitor_group = 'Returning Visitor' THEN cookie_user_id END) AS returning_users,
         count(DISTINCT session_id) AS sessions,
         count(DISTINCT CASE WHEN visitor_group = 'Returning Visitor' THEN session_id END) AS returning_sessions,
         sum(revenue) AS revenues,
         CAST(sum(booking_quantity_direct_before_cancellations_onsite_booking) AS BIGINT) AS onsite_bookings,
         CAST(sum(searches) AS BIGINT) AS searches,
         count(DISTINCT CASE WHEN booking_quantity_direct_before_cancellations_onsite_booking > 0 THEN cookie_user_id END) AS uwob
  FROM ({_traffic_sql(START)}) t GROUP BY 1, 2)
, c AS (
  SELECT *, CAST(sum(users) OVER w AS BIGINT) AS cum_users, sum(revenues) OVER w AS cum_revenues,
         CAST(sum(onsite_bookings) OVER w AS BIGINT) AS cum_onsite_bookings, CAST(sum(uwob) OVER w AS BIGINT) AS cum_uwob
  FROM d WINDOW w AS (PARTITION BY id ORDER BY dt))
SELECT dt, id, users, returning_users, returning_users / users AS returning_users_share,
       sessions, returning_sessions, returning_sessions / sessions AS returning_sessions_share,
       revenues, onsite_bookings, searches, uwob, cum_users, cum_revenues, cum_onsite_bookings, cum_uwob,
       cum_revenues / cum_users AS rpu, cum_onsite_bookings / cum_users AS onsite_booking_per_user
FROM c""", "ab_sessions"))(daily_kpis)


# --------------------------------------------------------------------- C-2
def subscription_rate(v: Views, start: str = START_LATE) -> DataFrame:
    """Session-based subscription rate per arm and day, running totals.

    ``uref`` is kept only for subscribers registered since ``start``; that
    condition depends on the CRM side alone, so the CRM table is filtered
    before the join instead of after it.
    """
    a = traffic(v, start).select("session_id", "session_timestamp", "id", "cookie_user_id")
    s = v.sessions.filter(E("uref").isNotNull()).select("session_id", "uref")
    c = (v.crm_users.filter((E("registration_date") >= F.lit(start).cast("date")) & E("is_subscriber"))
         .select(E("uref").alias("c_uref")))
    # the two small sides meet first: the wide table is then joined once, on its own key
    hit = s.join(c, E("uref") == E("c_uref")).select("session_id", "c_uref")
    j = a.join(hit, "session_id", "left")
    daily = j.groupBy("id", day_of("session_timestamp").alias("dt")).agg(
        F.count("cookie_user_id").alias("cookie_user_ids"), F.count("c_uref").alias("subscribers"))
    out = running(daily, ["id"], "dt", {"cum_users": "cookie_user_ids", "cum_subscribers": "subscribers"})
    return out.withColumn("subscription_rate", safe_div("cum_subscribers", "cum_users"))


register("c02_subscription_rate", floats={"subscription_rate": 6}, oracle=with_views(f"""
, a AS ({_traffic_sql(START_LATE)})
, u AS (
  SELECT a.id, CAST(a.session_timestamp AS DATE) AS dt, a.session_id, a.cookie_user_id,
         CASE WHEN c.registration_date >= DATE '{START_LATE}' AND c.is_subscriber = TRUE THEN c.uref END AS uref
  FROM a LEFT JOIN sessions s ON a.session_id = s.session_id
         LEFT JOIN crm_users c ON s.uref = c.uref)
, g AS (SELECT id, dt, count(cookie_user_id) AS cookie_user_ids, count(uref) AS subscribers FROM u GROUP BY ALL)
SELECT id, dt, cookie_user_ids, subscribers,
       CAST(sum(cookie_user_ids) OVER w AS BIGINT) AS cum_users,
       CAST(sum(subscribers) OVER w AS BIGINT) AS cum_subscribers,
       sum(subscribers) OVER w / sum(cookie_user_ids) OVER w AS subscription_rate
FROM g WINDOW w AS (PARTITION BY id ORDER BY dt)""", "ab_sessions", "sessions", "crm_users"))(subscription_rate)


# --------------------------------------------------------------------- C-3
MODAL_SUB = ["account_subscription_apple", "account_subscription_facebook",
             "account_subscription_google", "account_subscription_email"]
MODAL_CRE = ["account_creation_apple", "account_creation_facebook",
             "account_creation_google", "account_creation_email"]


def subscription_rate_events(v: Views, start: str = START, test_id: str = TEST_ID) -> DataFrame:
    """Event-based subscription and account-creation rates per arm and day."""
    a = traffic(v, start).select("session_id", "session_timestamp", "id", "cookie_user_id")
    m = (v.crm_modals
         .filter(E("test_ids").cast("string").like(f"%{test_id}%")
                 & (E("session_timestamp") >= F.lit(start).cast("timestamp")))
         .select("session_id",
                 sum((E(c) for c in MODAL_SUB[1:]), E(MODAL_SUB[0])).alias("account_subscription"),
                 sum((E(c) for c in MODAL_CRE[1:]), E(MODAL_CRE[0])).alias("account_creation")))
    j = a.join(m, "session_id", "left")
    daily = j.groupBy(day_of("session_timestamp").alias("dt"), "id").agg(
        F.count_distinct("cookie_user_id").alias("users"),
        F.sum("account_subscription").alias("account_subscriptions"),
        F.sum("account_creation").alias("account_creations"))
    out = running(daily, ["id"], "dt", {"cum_users": "users", "cum_account_subscription": "account_subscriptions",
                                        "cum_account_creation": "account_creations"})
    return out.withColumns({"subscription_rate": safe_div("cum_account_subscription", "cum_users"),
                            "creation_rate": safe_div("cum_account_creation", "cum_users")})


register("c03_subscription_rate_events", floats={"subscription_rate": 6, "creation_rate": 6}, oracle=with_views(f"""
, a AS ({_traffic_sql(START)})
, m AS (
  SELECT session_id,
         {' + '.join(MODAL_SUB)} AS account_subscription,
         {' + '.join(MODAL_CRE)} AS account_creation
  FROM crm_modals
  WHERE CAST(test_ids AS VARCHAR) LIKE '%{TEST_ID}%' AND session_timestamp >= TIMESTAMP '{START}')
, j AS (SELECT a.*, m.account_subscription, m.account_creation FROM a LEFT JOIN m USING (session_id))
, g AS (
  SELECT CAST(session_timestamp AS DATE) AS dt, id, count(DISTINCT cookie_user_id) AS users,
         CAST(sum(account_subscription) AS BIGINT) AS account_subscriptions,
         CAST(sum(account_creation) AS BIGINT) AS account_creations
  FROM j GROUP BY ALL)
SELECT *, CAST(sum(users) OVER w AS BIGINT) AS cum_users,
       CAST(sum(account_subscriptions) OVER w AS BIGINT) AS cum_account_subscription,
       CAST(sum(account_creations) OVER w AS BIGINT) AS cum_account_creation,
       sum(account_subscriptions) OVER w / sum(users) OVER w AS subscription_rate,
       sum(account_creations) OVER w / sum(users) OVER w AS creation_rate
FROM g WINDOW w AS (PARTITION BY id ORDER BY dt)""", "ab_sessions", "crm_modals"))(subscription_rate_events)


# --------------------------------------------------------------------- C-4
def new_subscribers_by_source(v: Views, start: str = START_LATE, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """New subscribers per CRM origin source, one column per arm (PIVOT).

    The WHERE on the CRM side turns both LEFT JOINs into inner joins; the
    pivot is a conditional count per listed arm (no pass to find values).
    """
    a = traffic(v, start).select("session_id", "id")
    s = v.sessions.filter(E("uref").isNotNull()).select("session_id", "uref")
    c = (v.crm_users.filter((E("registration_date") >= F.lit(start).cast("date")) & (E("is_subscriber") == True))  # noqa: E712
         .select("uref", "origin_source"))
    j = a.join(s, "session_id").join(c, "uref")
    return (j.groupBy("origin_source")
             .agg(*[F.count(F.when(E("id") == arm, E("uref"))).alias(arm) for arm in arms]))


register("c04_new_subscribers_by_source", oracle=with_views(f"""
, a AS ({_traffic_sql(START_LATE)})
, u AS (
  SELECT a.id, c.origin_source, c.uref
  FROM a LEFT JOIN sessions s ON a.session_id = s.session_id
         LEFT JOIN crm_users c ON s.uref = c.uref
  WHERE c.registration_date >= DATE '{START_LATE}' AND c.is_subscriber = TRUE)
SELECT origin_source, "arm0", "arm1"
FROM (PIVOT u ON id IN ('arm0', 'arm1') USING count(uref) GROUP BY origin_source)""",
    "ab_sessions", "sessions", "crm_users"))(new_subscribers_by_source)


# --------------------------------------------------------------------- C-5
OVERLAY = ("overlay_deals", "overlay_deals_south")


def overlay_installs(v: Views, start: str = INSTALL_START) -> DataFrame:
    """Overlay-campaign installs vs all installs by day (distinct users).

    Two distinct counts = one pre-aggregation to (day, user) carrying an
    "any overlay install" flag, then plain counts.
    """
    i = v.installs.filter((E("activity_kind") == "install") & (E("install_time") > F.lit(start).cast("timestamp")))
    per_user = (i.groupBy(day_of("install_time").alias("dt"), "app_user_id")
                 .agg(F.max(E("campaign_name").isin(*OVERLAY)).alias("overlay")))
    return per_user.groupBy("dt").agg(F.count_if("overlay").alias("overlay_installs"),
                                      F.count(F.lit(1)).alias("total_installs"))


register("c05_overlay_installs", oracle=with_views(f"""
SELECT CAST(install_time AS DATE) AS dt,
       count(DISTINCT CASE WHEN campaign_name IN ('{OVERLAY[0]}', '{OVERLAY[1]}') THEN app_user_id END) AS overlay_installs,
       count(DISTINCT app_user_id) AS total_installs
FROM installs
WHERE activity_kind = 'install' AND install_time > TIMESTAMP '{INSTALL_START}'
GROUP BY 1""", "installs"))(overlay_installs)


# --------------------------------------------------------------------- C-6
def overlay_clicks(v: Views, start: str = START_LATE) -> DataFrame:
    """Sessions and distinct overlay CTA clicks per arm.

    Clicks are reduced by a semi join on the in-scope sessions and
    de-duplicated; both steps are partitioned by session_id, so the later
    join back to the sessions reuses that partitioning.
    """
    s = traffic(v, start).select("session_id", "id")
    clicks = (v.interactions
              .filter((E("interaction_timestamp") >= F.lit(start).cast("timestamp"))
                      & (E("se_category") == "install_overlay")
                      & (E("metric_name") == "overlay_cta_click"))
              .select("session_id", "metric_name", "interactions_key")
              .join(s.select("session_id"), "session_id", "left_semi")
              .distinct())
    # sessions per arm; distinct click keys per arm (inner join: a LEFT
    # JOIN's unmatched rows carry no key and count nothing).
    n_sessions = s.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("sessions"))
    n_clicks = (s.distinct().join(clicks, "session_id")
                .select("id", "interactions_key").distinct()
                .groupBy("id").agg(F.count(F.lit(1)).alias("install_overlay")))
    return (n_sessions.join(n_clicks, "id", "left")
            .select("id", "sessions", F.coalesce("install_overlay", F.lit(0)).alias("install_overlay")))


register("c06_overlay_clicks", oracle=with_views(f"""
, s AS ({_traffic_sql(START_LATE)})
, o AS (
  SELECT session_id, metric_name, interactions_key FROM interactions
  WHERE interaction_timestamp >= TIMESTAMP '{START_LATE}'
    AND se_category = 'install_overlay'
    AND metric_name = 'overlay_cta_click'
    AND session_id IN (SELECT DISTINCT session_id FROM s)
  GROUP BY ALL)
SELECT id, count(DISTINCT s.session_id) AS sessions, count(DISTINCT o.interactions_key) AS install_overlay
FROM s LEFT JOIN o USING (session_id)
GROUP BY ALL""", "ab_sessions", "interactions"))(overlay_clicks)


# ------------------------------------------------------- S-1 .. S-3 (SQL text)
OVERLAY_SQL = """
SELECT to_date(install_time) AS dt,
       count(DISTINCT CASE WHEN campaign_name IN (:overlay_a, :overlay_b) THEN app_user_id END) AS overlay_installs,
       count(DISTINCT app_user_id) AS total_installs
FROM installs
WHERE activity_kind = 'install' AND install_time > to_timestamp(:start)
GROUP BY 1
"""


def overlay_installs_sql(v: Views, start: str = INSTALL_START) -> DataFrame:
    """C-5 as SQL text over a registered view with named parameters
    (``spark.sql(text, args=...)``: values are bound, never pasted)."""
    v.register("installs")
    return v.spark.sql(OVERLAY_SQL, args={"overlay_a": OVERLAY[0], "overlay_b": OVERLAY[1], "start": start})


register("c05_overlay_installs_sql", oracle=with_views(f"""
SELECT CAST(install_time AS DATE) AS dt,
       count(DISTINCT CASE WHEN campaign_name IN ('{OVERLAY[0]}', '{OVERLAY[1]}') THEN app_user_id END) AS overlay_installs,
       count(DISTINCT app_user_id) AS total_installs
FROM installs
WHERE activity_kind = 'install' AND install_time > TIMESTAMP '{INSTALL_START}'
GROUP BY 1""", "installs"))(overlay_installs_sql)


# ------------------------------------------- ordered and long forms (O-1, R-6)
_KPIS = REGISTRY["c01_daily_kpis"]


def daily_kpis_report(v: Views) -> DataFrame:
    """C-1 as the report prints it: ordered, missing values last."""
    return daily_kpis(v).orderBy(asc_last("dt"), asc_last("id"))


register("c01_daily_kpis_report", floats=_KPIS.floats,
         oracle=f"SELECT * FROM ({_KPIS.oracle}) ORDER BY dt NULLS LAST, id NULLS LAST")(daily_kpis_report)

LONG_METRICS = ["rpu", "onsite_booking_per_user", "returning_users_share", "returning_sessions_share"]


def daily_kpis_long(v: Views) -> DataFrame:
    """The ratios of C-1, one row per day, arm and metric."""
    return melt(daily_kpis(v).select("dt", "id", *LONG_METRICS), ["dt", "id"], LONG_METRICS, "metric", "value")


register("c01_daily_kpis_long", floats={"value": 6}, oracle=f"""
SELECT dt, id, metric, value FROM (
  UNPIVOT (SELECT dt, id, {", ".join(LONG_METRICS)} FROM ({_KPIS.oracle}))
  ON {", ".join(LONG_METRICS)} INTO NAME metric VALUE value)""")(daily_kpis_long)
