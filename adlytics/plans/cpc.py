"""Revenue-per-click estimate quality and CPC prediction bands (C-14 .. C-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlytics.functions.compat import bounded_bucket, safe_div
from adlytics.operators.quantile import exact_quantile
from adlytics.operators.windows import rolling_prev_rows, split_lag
from adlytics.oracle.views import with_views
from adlytics.plans.registry import register
from adlytics.sources.views import Views

E = F.col

AS_OF = "2024-01-31"      # stands for current_date of the original run
OBJECT_KEYS = ["provider_id", "site_id", "device_type", "offer_bidding_tags"]
ESTIMATE_KEYS = ["provider_id", "site_id", "device_type", "app_id"]


# -------------------------------------------------------------------- C-14
def estimate_error(v: Views) -> DataFrame:
    """Actual revenue minus the previous click's estimate within the same
    (provider, site, device, app); percentage error and good/bad labels
    (a NULL percentage is 'bad', as IFF's else branch)."""
    e = v.estimates
    j = split_lag(e, ESTIMATE_KEYS, "click_id_timestamp", "estimated_offsite_booking_rev", "_prev_est", tie=["click_id"])
    diff = E("actual_offsite_booking_rev") - E("_prev_est")
    pct = diff / E("actual_offsite_booking_rev").cast("double")   # FLOAT(6) is a 64-bit float in the warehouse
    return (j.withColumn("date", F.to_date("click_id_timestamp"))
             .withColumn("estimation_diff", diff)
             .withColumn("percent_diff", pct)
             .withColumn("est_power", F.when(E("percent_diff") <= 0.2, "good").otherwise("bad"))
             .withColumn("est_power_strict", F.when(E("percent_diff") <= 0.1, "good").otherwise("bad"))
             .drop("_prev_est"))


_EST_SQL = """
, est AS (
  SELECT *, CAST(click_id_timestamp AS DATE) AS date,
         actual_offsite_booking_rev - lag(estimated_offsite_booking_rev, 1) OVER (
             PARTITION BY provider_id, site_id, device_type, app_id ORDER BY click_id_timestamp, click_id) AS estimation_diff
  FROM estimates)
, est2 AS (SELECT *, estimation_diff / CAST(actual_offsite_booking_rev AS DOUBLE) AS percent_diff FROM est)
, est3 AS (SELECT *, CASE WHEN percent_diff <= 0.2 THEN 'good' ELSE 'bad' END AS est_power,
                  CASE WHEN percent_diff <= 0.1 THEN 'good' ELSE 'bad' END AS est_power_strict FROM est2)"""

register("c14_estimate_error",
         floats={"actual_offsite_booking_rev": 6, "estimated_offsite_booking_rev": 6, "estimation_diff": 6,
                 "percent_diff": 6},
         oracle=with_views(_EST_SQL + "\nSELECT * FROM est3", "estimates"))(estimate_error)


def estimate_share(v: Views) -> DataFrame:
    """Clicks per day and strict label, and each label's share of the day."""
    c = estimate_error(v).groupBy("date", "est_power_strict").agg(F.count("click_id").alias("click_id"))
    return c.withColumn("total", E("click_id") / F.sum("click_id").over(Window.partitionBy("date")))


register("c14_estimate_share", floats={"total": 6}, oracle=with_views(_EST_SQL + """
, c AS (SELECT date, est_power_strict, count(click_id) AS click_id FROM est3 GROUP BY 1, 2)
SELECT *, click_id / sum(click_id) OVER (PARTITION BY date) AS total FROM c""", "estimates"))(estimate_share)


def estimate_share_wide(v: Views) -> DataFrame:
    """The same as a date x label table (pivot with fixed labels)."""
    c = estimate_share(v)
    return c.groupBy("date").agg(
        *[F.first(F.when(E("est_power_strict") == lab, E("click_id")), ignorenulls=True).alias(f"clicks_{lab}")
          for lab in ("good", "bad")],
        *[F.first(F.when(E("est_power_strict") == lab, E("total")), ignorenulls=True).alias(f"share_{lab}")
          for lab in ("good", "bad")])


register("c14_estimate_share_wide", floats={"share_good": 6, "share_bad": 6}, oracle=with_views(_EST_SQL + """
, c AS (SELECT date, est_power_strict, count(click_id) AS click_id FROM est3 GROUP BY 1, 2)
, s AS (SELECT *, click_id / sum(click_id) OVER (PARTITION BY date) AS total FROM c)
SELECT date,
       max(CASE WHEN est_power_strict = 'good' THEN click_id END) AS clicks_good,
       max(CASE WHEN est_power_strict = 'bad' THEN click_id END) AS clicks_bad,
       max(CASE WHEN est_power_strict = 'good' THEN total END) AS share_good,
       max(CASE WHEN est_power_strict = 'bad' THEN total END) AS share_bad
FROM s GROUP BY 1""", "estimates"))(estimate_share_wide)


def estimate_totals(v: Views) -> DataFrame:
    e = estimate_error(v)
    return e.agg(F.sum("estimation_diff").alias("sum_estimation_diff"),
                 F.sum("actual_offsite_booking_rev").alias("sum_actual"))


register("c14_estimate_totals", floats={"sum_estimation_diff": 4, "sum_actual": 4}, oracle=with_views(_EST_SQL + """
SELECT sum(estimation_diff) AS sum_estimation_diff, sum(actual_offsite_booking_rev) AS sum_actual FROM est3""",
    "estimates"))(estimate_totals)


# -------------------------------------------------------------------- C-15
def _clicks(v: Views, lookback: int, as_of: str) -> DataFrame:
    return (v.micro_conversions
            .filter(E("click_id_timestamp") > F.date_sub(F.lit(as_of).cast("date"), lookback))
            .withColumn("object", F.concat(*OBJECT_KEYS)))


def cpc_profile(v: Views, as_of: str = AS_OF) -> DataFrame:
    """Per-object CPC profile (mean, exact median, sample sd) over 90 days,
    joined to each click of 91 days with its mean of the previous 7 clicks.
    The join is on the four key columns (the concatenated key can merge
    different keys, D20)."""
    p = _clicks(v, 90, as_of).filter(E("revenue_cpc") > 0)
    prof = (p.groupBy(*OBJECT_KEYS).agg(F.avg("revenue_cpc").alias("avg_revenue_cpc"),
                                        F.stddev_samp("revenue_cpc").alias("std_revenue_cpc"))
            .join(exact_quantile(p, OBJECT_KEYS, "revenue_cpc", 0.5, "median_revenue_cpc"), OBJECT_KEYS))
    profile = ["avg_revenue_cpc", "median_revenue_cpc", "std_revenue_cpc"]
    m = _clicks(v, 91, as_of).select(*OBJECT_KEYS, "object", "click_id", "click_id_timestamp", "revenue_cpc")
    j = m.join(prof, OBJECT_KEYS).select("object", "click_id_timestamp", "revenue_cpc", "click_id", *profile)
    # 7 previous clicks per object, computed in (object, day) partitions
    j = rolling_prev_rows(j, ["object"], "click_id_timestamp", "revenue_cpc", 7, {"avg_7d": "avg"},
                          tie=["click_id", *profile])
    return (j
             .select("click_id_timestamp", "object", "revenue_cpc", "avg_7d",
                     (E("avg_7d") - E("revenue_cpc")).alias("cpc_mismatch"),
                     "avg_revenue_cpc", "median_revenue_cpc", "std_revenue_cpc"))


_OBJ = "concat(provider_id, site_id, device_type, offer_bidding_tags)"
register("c15_cpc_profile",
         floats={"avg_7d": 6, "cpc_mismatch": 6, "avg_revenue_cpc": 6, "median_revenue_cpc": 6, "std_revenue_cpc": 6},
         oracle=with_views(f"""
, c AS (
  SELECT provider_id, site_id, device_type, offer_bidding_tags,
         avg(revenue_cpc) AS avg_revenue_cpc, median(revenue_cpc) AS median_revenue_cpc,
         stddev_samp(revenue_cpc) AS std_revenue_cpc
  FROM micro_conversions WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 90
  GROUP BY 1, 2, 3, 4)
, mm AS (
  SELECT m.click_id, m.click_id_timestamp, {_OBJ.replace('provider_id', 'm.provider_id').replace('site_id', 'm.site_id').replace('device_type', 'm.device_type').replace('offer_bidding_tags', 'm.offer_bidding_tags')} AS object,
         m.revenue_cpc, c.avg_revenue_cpc, c.median_revenue_cpc, c.std_revenue_cpc
  FROM micro_conversions m
  JOIN c ON m.provider_id = c.provider_id AND m.site_id = c.site_id AND m.device_type = c.device_type
        AND m.offer_bidding_tags = c.offer_bidding_tags
  WHERE m.click_id_timestamp > DATE '{AS_OF}' - 91)
SELECT click_id_timestamp, object, revenue_cpc,
       avg(revenue_cpc) OVER w AS avg_7d,
       avg(revenue_cpc) OVER w - revenue_cpc AS cpc_mismatch,
       avg_revenue_cpc, median_revenue_cpc, std_revenue_cpc
FROM mm WINDOW w AS (PARTITION BY object ORDER BY click_id_timestamp, click_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    "micro_conversions"))(cpc_profile)


# -------------------------------------------------------------- C-16, C-17
def _band(df: DataFrame, alone: bool = True) -> DataFrame:
    """Prediction band from the previous 7 clicks of the same object."""
    r = rolling_prev_rows(df.select("object", "click_id_timestamp", "click_id", "revenue_cpc"), ["object"],
                          "click_id_timestamp", "revenue_cpc", 7, {"_avg7": "avg", "_std7": "stddev"},
                          tie=["click_id"], alone=alone)
    return (r.withColumn("avg_7clicks", F.coalesce(F.col("_avg7"), F.lit(0.0)))
              .withColumn("std_7clicks", F.coalesce(F.col("_std7"), F.lit(0.0)))
              .drop("_avg7", "_std7")
              .withColumn("lower_bound_revenue_cpc", E("avg_7clicks") - 1.96 * E("std_7clicks"))
              .withColumn("upper_bound_revenue_cpc", E("avg_7clicks") + 1.96 * E("std_7clicks"))
              .withColumn("cpc_mismatch", E("avg_7clicks") - E("revenue_cpc"))
              .withColumn("pct_mismatch", safe_div("cpc_mismatch", "revenue_cpc"))
              .withColumn("predict_performance",
                          F.when((E("revenue_cpc") >= E("lower_bound_revenue_cpc"))
                                 & (E("revenue_cpc") <= E("upper_bound_revenue_cpc")), "good").otherwise("bad")))


BAND_COLS = ["click_id_timestamp", "object", "revenue_cpc", "avg_7clicks", "std_7clicks",
             "lower_bound_revenue_cpc", "upper_bound_revenue_cpc", "cpc_mismatch", "pct_mismatch",
             "predict_performance"]
BAND_FLOATS = {c: 6 for c in BAND_COLS[3:9]}


def cpc_band_all(v: Views, as_of: str = AS_OF) -> DataFrame:
    m = _clicks(v, 91, as_of).filter(E("revenue_cpc") > 0)
    return _band(m).select(*BAND_COLS)


def _band_sql(src: str) -> str:
    return f"""
, b0 AS ({src})
, b1 AS (
  SELECT click_id_timestamp, object, revenue_cpc,
         coalesce(avg(revenue_cpc) OVER w, 0) AS avg_7clicks,
         coalesce(stddev_samp(revenue_cpc) OVER w, 0) AS std_7clicks
  FROM b0 WINDOW w AS (PARTITION BY object ORDER BY click_id_timestamp, click_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
, b2 AS (
  SELECT *, avg_7clicks - 1.96 * std_7clicks AS lower_bound_revenue_cpc,
         avg_7clicks + 1.96 * std_7clicks AS upper_bound_revenue_cpc,
         avg_7clicks - revenue_cpc AS cpc_mismatch
  FROM b1)
, band AS (
  SELECT *, cpc_mismatch / revenue_cpc AS pct_mismatch,
         CASE WHEN revenue_cpc >= lower_bound_revenue_cpc AND revenue_cpc <= upper_bound_revenue_cpc
              THEN 'good' ELSE 'bad' END AS predict_performance
  FROM b2)"""


register("c16_cpc_band", floats=BAND_FLOATS, oracle=with_views(_band_sql(f"""
  SELECT click_id, click_id_timestamp, {_OBJ} AS object, revenue_cpc FROM micro_conversions
  WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 91""") + f"\nSELECT {', '.join(BAND_COLS)} FROM band",
    "micro_conversions"))(cpc_band_all)


def cpc_band_repeat_objects(v: Views, as_of: str = AS_OF) -> DataFrame:
    """The band for objects with at least two clicks in 90 days (row_number > 1,
    i.e. QUALIFY: the rolling window leaves out objects of a single click)."""
    return _band(_clicks(v, 90, as_of).filter(E("revenue_cpc") > 0), alone=False).select(*BAND_COLS)


register("c17_cpc_band_repeat", floats=BAND_FLOATS, oracle=with_views(f"""
, repeat_objects AS (
  SELECT object FROM (
    SELECT {_OBJ} AS object, row_number() OVER (PARTITION BY {_OBJ} ORDER BY click_id_timestamp) AS rn
    FROM micro_conversions WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 90) q
  WHERE rn > 1)""" + _band_sql(f"""
  SELECT click_id, click_id_timestamp, {_OBJ} AS object, revenue_cpc FROM micro_conversions
  WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 90
    AND {_OBJ} IN (SELECT DISTINCT object FROM repeat_objects)""") + f"\nSELECT {', '.join(BAND_COLS)} FROM band",
    "micro_conversions"))(cpc_band_repeat_objects)


# -------------------------------------------------------------------- C-18
def top_objects(v: Views, k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """The k objects with most clicks (ties by object name): a top-k report.
    The band has every click of an object with two or more, so they are counted without it."""
    m = _clicks(v, 90, as_of).filter(E("revenue_cpc") > 0)
    c = m.groupBy("object").agg(F.count(F.lit(1)).alias("clicks")).filter(E("clicks") > 1)
    return c.orderBy(E("clicks").desc(), E("object").asc()).limit(k)


_C17_SQL = f"""
, repeat_objects AS (
  SELECT object FROM (
    SELECT {_OBJ} AS object, row_number() OVER (PARTITION BY {_OBJ} ORDER BY click_id_timestamp) AS rn
    FROM micro_conversions WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 90) q
  WHERE rn > 1)""" + _band_sql(f"""
  SELECT click_id, click_id_timestamp, {_OBJ} AS object, revenue_cpc FROM micro_conversions
  WHERE revenue_cpc > 0 AND click_id_timestamp > DATE '{AS_OF}' - 90
    AND {_OBJ} IN (SELECT DISTINCT object FROM repeat_objects)""")

register("c18_top_objects", oracle=with_views(_C17_SQL + """
SELECT object, count(*) AS clicks FROM band GROUP BY 1 ORDER BY clicks DESC, object LIMIT 10""",
    "micro_conversions"))(top_objects)


def top_object_histograms(v: Views, k: int = 10, bins: int = 20) -> DataFrame:
    """Density histogram (``bins`` equal-width bins over each object's own
    min..max) of the CPC of the top-k objects.  The top-k list is at most k
    rows and is broadcast into a semi join."""
    top = F.broadcast(top_objects(v, k).select("object"))
    # equal values are counted once, for the range and for the bins
    rows = (_clicks(v, 90, AS_OF).filter(E("revenue_cpc") > 0).join(top, "object", "left_semi")
            .groupBy("object", "revenue_cpc").agg(F.count(F.lit(1)).alias("c")))
    rng = rows.groupBy("object").agg(F.min("revenue_cpc").alias("lo"), F.max("revenue_cpc").alias("hi"),
                                     F.sum("c").alias("n"))
    rng = rng.withColumns({"lo": F.when(E("lo") == E("hi"), E("lo") - 0.5).otherwise(E("lo")),
                           "hi": F.when(E("lo") == E("hi"), E("hi") + 0.5).otherwise(E("hi"))})
    hit = (rows.join(F.broadcast(rng), "object")
               .withColumn("bin", bounded_bucket("revenue_cpc", E("lo"), E("hi"), bins).cast("bigint"))
               .groupBy("object", "bin").agg(F.sum("c").alias("count")))
    # every bin of every object, also the empty ones
    every = rng.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    h = every.join(hit, ["object", "bin"], "left").fillna(0, ["count"])
    width = (E("hi") - E("lo")) / bins
    return h.select("object", "bin", (E("lo") + (E("bin") - 1) * width).alias("bin_start"),
                    "count", (E("count") / (E("n") * width)).alias("density"))


register("c18_top_object_histograms", floats={"bin_start": 6, "density": 6}, oracle=with_views(_C17_SQL + """
, top AS (SELECT object, count(*) AS clicks FROM band GROUP BY 1 ORDER BY clicks DESC, object LIMIT 10)
, rows_ AS (SELECT object, revenue_cpc FROM band WHERE object IN (SELECT object FROM top))
, r0 AS (SELECT object, min(revenue_cpc) AS lo0, max(revenue_cpc) AS hi0, count(*) AS n FROM rows_ GROUP BY 1)
, rng AS (SELECT object, n, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                 CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0)
, hit AS (
  SELECT rows_.object, least(CAST(floor((revenue_cpc - lo) / (hi - lo) * 20) AS BIGINT) + 1, 20) AS bin, count(*) AS hits
  FROM rows_ JOIN rng USING (object) GROUP BY ALL)
, h AS (
  SELECT e.*, coalesce(hits, 0) AS count
  FROM (SELECT *, unnest(range(1, 21)) AS bin FROM rng) e LEFT JOIN hit USING (object, bin))
SELECT object, bin, lo + (bin - 1) * ((hi - lo) / 20) AS bin_start, count,
       count / (n * ((hi - lo) / 20)) AS density
FROM h""", "micro_conversions"))(top_object_histograms)


def mismatch_histogram(v: Views, bins: int = 11, lo: float = -0.001, hi: float = 0.001) -> DataFrame:
    """Counts of pct_mismatch in ``bins`` equal bins over [lo, hi] (values
    outside the range are left out, the maximum goes to the last bin)."""
    b = cpc_band_repeat_objects(v).filter((E("pct_mismatch") >= lo) & (E("pct_mismatch") <= hi))
    hit = (b.groupBy(bounded_bucket("pct_mismatch", lo, hi, bins).cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("count")))
    every = v.spark.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(hit, "bin", "left").fillna(0, ["count"])


register("c18_mismatch_histogram", oracle=with_views(_C17_SQL + """
, hit AS (
  SELECT least(CAST(floor((pct_mismatch - (-0.001)) / (0.001 - (-0.001)) * 11) AS BIGINT) + 1, 11) AS bin, count(*) AS hits
  FROM band WHERE pct_mismatch >= -0.001 AND pct_mismatch <= 0.001 GROUP BY 1)
SELECT b.bin, coalesce(hits, 0) AS count FROM (SELECT unnest(range(1, 12)) AS bin) b LEFT JOIN hit USING (bin)""", "micro_conversions"))(mismatch_histogram)


def mismatch_value_counts(v: Views) -> DataFrame:
    b = cpc_band_repeat_objects(v)
    return b.groupBy(F.round("pct_mismatch", 6).alias("pct_mismatch")).agg(F.count(F.lit(1)).alias("count"))


register("c18_mismatch_value_counts", oracle=with_views(_C17_SQL + """
SELECT round(pct_mismatch, 6) AS pct_mismatch, count(*) AS count FROM band GROUP BY 1""",
    "micro_conversions"))(mismatch_value_counts)


def performance_share(v: Views) -> DataFrame:
    b = cpc_band_repeat_objects(v)
    c = b.groupBy("predict_performance").agg(F.count("revenue_cpc").alias("clicks"))
    return c.withColumn("share", E("clicks") / F.sum("clicks").over(Window.partitionBy()))


register("c18_performance_share", floats={"share": 6}, oracle=with_views(_C17_SQL + """
, c AS (SELECT predict_performance, count(revenue_cpc) AS clicks FROM band GROUP BY 1)
SELECT *, clicks / sum(clicks) OVER () AS share FROM c""", "micro_conversions"))(performance_share)


def mismatch_rmse(v: Views) -> DataFrame:
    """RMSE of pct_mismatch against 0."""
    b = cpc_band_repeat_objects(v)
    return b.agg(F.sqrt(F.avg(E("pct_mismatch") * E("pct_mismatch"))).alias("rmse"))


register("c18_mismatch_rmse", floats={"rmse": 6}, oracle=with_views(_C17_SQL + """
SELECT sqrt(avg(pct_mismatch * pct_mismatch)) AS rmse FROM band""", "micro_conversions"))(mismatch_rmse)
