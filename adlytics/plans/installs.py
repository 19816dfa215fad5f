"""App installs by platform and source; paid vs organic (C-19, C-20).
The curve fits of C-21 are in ``fits``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.functions.compat import day_of
from adlytics.oracle.views import with_views
from adlytics.plans.registry import register
from adlytics.sources.views import Views

E = F.col

START = "2024-01-02"
END = "2024-01-29"
APP_IDS = ("com.app", "1104")
PAID_SOURCES = ("Facebook Ads", "googleadwords_int", "Apple Search Ads")
PLATFORMS = ("android", "ios")


# -------------------------------------------------------------------- C-19
def installs_daily(v: Views, start: str = START, end: str = END) -> DataFrame:
    """Installs by day, platform, app and media source.  The three
    conditional distinct counts share one distinct column, so one
    pre-aggregation to (group, install id) with flags replaces them."""
    i = (v.installs
         .filter(E("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
                 & E("app_id").isin(*APP_IDS))
         .select(day_of("date").alias("dt"), E("os_name").alias("platform"),
                 F.when(E("os_name") == "ios", F.concat(F.lit("id"), E("app_id"))).otherwise(E("app_id")).alias("app_id"),
                 "media_source", "tracker_id", "event_name"))
    keys = ["dt", "platform", "app_id", "media_source"]
    per_id = i.groupBy(*keys, "tracker_id").agg(
        F.max(E("event_name") == "install").alias("is_install"),
        F.max(E("event_name") == "retargeting").alias("is_retargeting"),
        F.max(E("event_name") == "uninstall").alias("is_uninstall"),
        F.sum(F.when(E("event_name") == "af_skad_install", 1).otherwise(0)).alias("skad"))
    g = per_id.groupBy(*keys).agg(
        F.count_if("is_install").alias("regular_installs"), F.sum("skad").alias("skad_installs"),
        F.count_if("is_retargeting").alias("retargeting"), F.count_if("is_uninstall").alias("uninstalls"))
    return g.select(*keys, (E("regular_installs") + E("skad_installs")).alias("total_installs"),
                    "regular_installs", "skad_installs", "retargeting", "uninstalls", F.lit(0).alias("cost"))


_INSTALLS_SQL = f"""
, inst AS (
  SELECT CAST(date AS DATE) AS dt, os_name AS platform,
         CASE WHEN os_name = 'ios' THEN 'id' || app_id ELSE app_id END AS app_id, media_source,
         count(DISTINCT CASE WHEN event_name = 'install' THEN tracker_id END)
           + CAST(sum(CASE WHEN event_name = 'af_skad_install' THEN 1 ELSE 0 END) AS BIGINT) AS total_installs,
         count(DISTINCT CASE WHEN event_name = 'install' THEN tracker_id END) AS regular_installs,
         CAST(sum(CASE WHEN event_name = 'af_skad_install' THEN 1 ELSE 0 END) AS BIGINT) AS skad_installs,
         count(DISTINCT CASE WHEN event_name = 'retargeting' THEN tracker_id END) AS retargeting,
         count(DISTINCT CASE WHEN event_name = 'uninstall' THEN tracker_id END) AS uninstalls,
         0 AS cost
  FROM installs
  WHERE date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND app_id IN ('com.app', '1104')
  GROUP BY 1, 2, 3, 4)"""

register("c19_installs_daily", oracle=with_views(_INSTALLS_SQL + "\nSELECT * FROM inst", "installs"))(installs_daily)


# -------------------------------------------------------------------- C-20
def paid_organic_daily(v: Views) -> DataFrame:
    """Daily paid and organic installs per platform on a gap-free calendar
    (days without installs count 0, as pandas ``resample('1D').sum()``)."""
    # one row a day and platform, then one row in all, whose length the calendar bounds
    d = installs_daily(v).groupBy("dt", "platform").agg(
        F.sum(F.when(E("media_source").isin(*PAID_SOURCES), E("total_installs"))).alias("paid"),
        F.sum(F.when(E("media_source") == "organic", E("total_installs"))).alias("organic"))
    known = F.when(E("platform").isin(*PLATFORMS), F.struct(F.struct("dt", "platform"), F.struct("paid", "organic")))
    one = d.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.map_from_entries(F.collect_list(known)).alias("found"))
    grid = (one.filter(E("lo").isNotNull())
            .select(F.explode(F.sequence("lo", "hi")).alias("dt"), "found")
            .select("dt", F.explode(F.array(*[F.lit(p) for p in PLATFORMS])).alias("platform"), "found")
            .select("dt", "platform", F.try_element_at("found", F.struct("dt", "platform")).alias("x")))
    return grid.select("dt", "platform", F.coalesce("x.paid", F.lit(0)).alias("paid"),
                       F.coalesce("x.organic", F.lit(0)).alias("organic"))


_PO_SQL = _INSTALLS_SQL + """
, paid AS (SELECT dt, platform, sum(total_installs) AS paid FROM inst
           WHERE media_source IN ('Facebook Ads', 'googleadwords_int', 'Apple Search Ads') GROUP BY 1, 2)
, org AS (SELECT dt, platform, sum(total_installs) AS organic FROM inst WHERE media_source = 'organic' GROUP BY 1, 2)
, spine AS (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM inst)
, grid AS (SELECT dt, platform FROM spine CROSS JOIN (VALUES ('android'), ('ios')) p(platform))
, po AS (SELECT g.dt, g.platform, CAST(coalesce(paid, 0) AS BIGINT) AS paid, CAST(coalesce(organic, 0) AS BIGINT) AS organic
         FROM grid g LEFT JOIN paid USING (dt, platform) LEFT JOIN org USING (dt, platform))"""

register("c20_paid_organic_daily", oracle=with_views(_PO_SQL + "\nSELECT * FROM po", "installs"))(paid_organic_daily)


def paid_organic_correlation(v: Views) -> DataFrame:
    """Pearson correlation of daily paid and organic installs per platform."""
    return (paid_organic_daily(v).groupBy("platform")
            .agg(F.corr(E("paid").cast("double"), E("organic").cast("double")).alias("correlation")))


register("c20_paid_organic_correlation", floats={"correlation": 6}, oracle=with_views(_PO_SQL + """
SELECT platform, corr(CAST(paid AS DOUBLE), CAST(organic AS DOUBLE)) AS correlation FROM po GROUP BY 1""",
    "installs"))(paid_organic_correlation)
