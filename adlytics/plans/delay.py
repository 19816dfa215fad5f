"""Conversion-upload delay detection (C-7 .. C-9).

An upload log gives one timestamp per export; the gaps between consecutive
exports (overall and within a day) flag days whose uploads were late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.functions.compat import day_of, hour_boundaries, week_of
from adlytics.operators.windows import global_lead
from adlytics.oracle.views import with_views
from adlytics.plans.registry import REGISTRY, register
from adlytics.sources.views import Views

E = F.col

START = "2024-01-01"
AS_OF = "2024-01-31"          # stands for current_date() of the original run
ALLOWANCE_DAILY = 6
ALLOWANCE_WEEKLY = 8


# --------------------------------------------------------------------- C-7
def upload_gaps(v: Views, start: str = START) -> DataFrame:
    """Each distinct upload time with the next upload overall and within its
    day, and the hour boundaries between them."""
    u = (v.uploads.filter(E("export_updated_at_utc") >= F.lit(start).cast("timestamp"))
         .select(E("export_updated_at_utc").alias("response_ts")).distinct())
    g = global_lead(u, "response_ts", out="next", in_day_out="next_intraday")
    return g.select("response_ts", "next", "next_intraday",
                    hour_boundaries("response_ts", "next").alias("diff_in_hours"),
                    hour_boundaries("response_ts", "next_intraday").alias("diff_in_hours_intraday"))


_GAPS_SQL = f"""
, r AS (SELECT DISTINCT export_updated_at_utc AS response_ts FROM uploads
        WHERE export_updated_at_utc >= TIMESTAMP '{START}')
, l AS (
  SELECT response_ts,
         lead(response_ts) OVER (ORDER BY response_ts) AS next,
         lead(response_ts) OVER (PARTITION BY CAST(response_ts AS DATE) ORDER BY response_ts) AS next_intraday
  FROM r)
, diffs AS (
  SELECT *, date_diff('hour', response_ts, next) AS diff_in_hours,
         date_diff('hour', response_ts, next_intraday) AS diff_in_hours_intraday
  FROM l)"""

register("c07_upload_gaps", oracle=with_views(_GAPS_SQL + "\nSELECT * FROM diffs", "uploads"))(upload_gaps)


# --------------------------------------------------------------------- C-8
def delay_days(v: Views, allowance: int = ALLOWANCE_DAILY, start: str = START) -> DataFrame:
    """Per-day gap statistics and the delay flag."""
    d = upload_gaps(v, start)
    agg = d.groupBy(day_of("response_ts").alias("dt")).agg(
        F.avg("diff_in_hours").alias("mean"), F.stddev_samp("diff_in_hours").alias("std"),
        F.max("diff_in_hours").alias("max"),
        F.avg("diff_in_hours_intraday").alias("mean_intraday"),
        F.stddev_samp("diff_in_hours_intraday").alias("std_intraday"),
        F.max("diff_in_hours_intraday").alias("max_intraday"),
        F.sum("diff_in_hours_intraday").alias("sum_intraday"))
    return agg.withColumn("delay", F.when(E("max_intraday") > 12 + allowance, 1)
                                    .when(E("sum_intraday") < 16 - allowance, 1)
                                    .when(E("max") >= 24, 1).otherwise(0))


def daily_spend(v: Views, start: str = START) -> DataFrame:
    a = v.ads_report.filter(E("date") >= F.lit(start).cast("timestamp"))
    return a.groupBy(day_of("date").alias("dt")).agg(
        F.sum("cost").alias("spend"), F.sum("clicks").alias("clicks"), F.sum("revenue").alias("revenue"))


def delay_daily(v: Views, allowance: int = ALLOWANCE_DAILY, as_of: str = AS_OF) -> DataFrame:
    """Delay flags fully joined with ad spend by day (``USING`` merges dt)."""
    j = delay_days(v, allowance).join(daily_spend(v), ["dt"], "full")
    return j.filter(E("dt") < F.lit(as_of).cast("date"))


_DELAY_SQL = _GAPS_SQL + """
, gaps AS (
  SELECT CAST(response_ts AS DATE) AS dt,
         avg(diff_in_hours) AS "mean", stddev_samp(diff_in_hours) AS std, max(diff_in_hours) AS "max",
         avg(diff_in_hours_intraday) AS mean_intraday, stddev_samp(diff_in_hours_intraday) AS std_intraday,
         max(diff_in_hours_intraday) AS max_intraday, sum(diff_in_hours_intraday) AS sum_intraday
  FROM diffs GROUP BY 1)
, gaps_filled AS (
  SELECT *, CASE WHEN max_intraday > 12 + {allowance} THEN 1 WHEN sum_intraday < 16 - {allowance} THEN 1
                 WHEN "max" >= 24 THEN 1 ELSE 0 END AS delay
  FROM gaps)
, ads AS (
  SELECT CAST(date AS DATE) AS dt, sum(cost) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks, sum(revenue) AS revenue
  FROM ads_report WHERE date >= TIMESTAMP '""" + START + """' GROUP BY 1)
"""

register("c08_delay_daily",
         floats={"mean": 6, "std": 6, "mean_intraday": 6, "std_intraday": 6, "spend": 4, "revenue": 4},
         oracle=with_views(_DELAY_SQL.format(allowance=ALLOWANCE_DAILY) + f"""
SELECT dt, "mean", std, "max", mean_intraday, std_intraday, max_intraday, CAST(sum_intraday AS BIGINT) AS sum_intraday,
       delay, spend, clicks, revenue
FROM gaps_filled FULL JOIN ads USING (dt)
WHERE dt < DATE '{AS_OF}'""", "uploads", "ads_report"))(delay_daily)


# --------------------------------------------------------------------- C-9
def delay_weekly(v: Views, allowance: int = ALLOWANCE_WEEKLY, as_of: str = AS_OF) -> DataFrame:
    """Weekly roll-up: a week is delayed if any of its days is."""
    j = delay_days(v, allowance).join(daily_spend(v), ["dt"], "full")
    w = j.groupBy(week_of("dt").alias("week")).agg(
        F.when(F.sum("delay") > 0, 1).otherwise(0).alias("delay_in_week"),
        F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"), F.sum("revenue").alias("revenue"))
    return w.filter(E("week") < F.lit(as_of).cast("date"))


register("c09_delay_weekly", floats={"spend": 4, "revenue": 4},
         oracle=with_views(_DELAY_SQL.format(allowance=ALLOWANCE_WEEKLY) + f"""
, f AS (
  SELECT CAST(date_trunc('week', dt) AS DATE) AS week,
         CASE WHEN sum(delay) > 0 THEN 1 ELSE 0 END AS delay_in_week,
         sum(spend) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks, sum(revenue) AS revenue
  FROM gaps_filled FULL JOIN ads USING (dt)
  GROUP BY ALL)
SELECT * FROM f WHERE week < DATE '{AS_OF}'""", "uploads", "ads_report"))(delay_weekly)


def delay_tail(v: Views, days: int = 5) -> DataFrame:
    """The last days of C-8 in date order (O-3), a short report."""
    return delay_daily(v).orderBy(E("dt").desc_nulls_last()).limit(days).orderBy("dt")


_DAILY = REGISTRY["c08_delay_daily"]
register("c08_delay_tail", floats=_DAILY.floats,
         oracle=f"SELECT * FROM (SELECT * FROM ({_DAILY.oracle}) ORDER BY dt DESC NULLS LAST LIMIT 5) ORDER BY dt")(delay_tail)
