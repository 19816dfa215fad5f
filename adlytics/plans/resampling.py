"""Bootstrap resampling of the daily revenue series (X-1 .. X-3, X-8, A-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlytics.functions.compat import half_even
from adlytics.functions.draws import sql_hash_int
from adlytics.operators import resample as R
from adlytics.operators.reshape import fill_calendar
from adlytics.oracle.views import with_views
from adlytics.plans import installs as I
from adlytics.plans.registry import register
from adlytics.plans.revenue import revenue_input
from adlytics.sources.views import Views

E = F.col

METRIC = "booking_revenues"
CUTOFF = "1998-07-04"
IID_REPS = 20
BLOCK_REPS = 49
SEED = 42


def daily_series(v: Views, metric: str = METRIC, cutoff: str = CUTOFF) -> DataFrame:
    """A-11 + R-4: per region, the rounded (half-even) daily sum of the metric
    before the cut-off on a gap-free calendar (missing days 0), indexed."""
    r = revenue_input(v).filter(E("date") < F.lit(cutoff).cast("date"))
    d = (r.groupBy(E("site_global_region").alias("series"), "date")
          .agg(half_even(F.sum(metric), 0).alias("value")))
    d = fill_calendar(d, ["series"], "date", ["value"])
    w = Window.partitionBy("series").orderBy("date")
    return d.withColumn("idx", F.row_number().over(w) - 1).select("series", "date", "idx", "value")


_SERIES_SQL = f"""
, d0 AS (
  SELECT site_global_region AS series, date, round_even(sum(est_revenue_before_cancellations), 0) AS value
  FROM main_revenues WHERE date < DATE '{CUTOFF}' GROUP BY 1, 2)
, b AS (SELECT series, min(date) AS lo, max(date) AS hi FROM d0 GROUP BY 1)
, sp AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
, s AS (
  SELECT sp.series, sp.date, CAST(row_number() OVER (PARTITION BY sp.series ORDER BY sp.date) - 1 AS INTEGER) AS idx,
         coalesce(d0.value, 0) AS value
  FROM sp LEFT JOIN d0 USING (series, date))
, n AS (SELECT series, count(*) AS n FROM s GROUP BY 1)"""

register("x01_daily_revenue_series", floats={"value": 2},
         oracle=with_views(_SERIES_SQL + "\nSELECT series, date, idx, value FROM s", "main_revenues"))(daily_series)


def iid_bootstrap(v: Views) -> DataFrame:
    return R.iid_bootstrap(daily_series(v).select("series", "idx", "value"), IID_REPS, SEED)


register("x02_iid_bootstrap", floats={"value": 2}, oracle=with_views(_SERIES_SQL + f"""
, d AS (SELECT series, n, unnest(range(0, {IID_REPS})) AS rep FROM n)
, d2 AS (SELECT series, n, rep, unnest(range(0, n)) AS idx FROM d)
, d3 AS (SELECT *, {sql_hash_int(str(SEED), 'series', 'rep', 'idx')} % n AS src FROM d2)
SELECT d3.series, CAST(rep AS INTEGER) AS rep, CAST(d3.idx AS INTEGER) AS idx, src, s.value
FROM d3 JOIN s ON s.series = d3.series AND s.idx = d3.src""",
    "main_revenues"))(iid_bootstrap)


def block_bootstrap(v: Views) -> DataFrame:
    return R.circular_block_bootstrap(daily_series(v).select("series", "idx", "value"), BLOCK_REPS, SEED)


register("x03_block_bootstrap", floats={"value": 2}, oracle=with_views(_SERIES_SQL + f"""
, nb AS (SELECT series, n, CAST(floor(pow(n, 0.2)) AS INTEGER) AS b FROM n)
, nb2 AS (SELECT *, CAST(ceil(n / b) AS INTEGER) AS nblk FROM nb)
, d AS (SELECT series, n, b, nblk, unnest(range(0, {BLOCK_REPS})) AS rep FROM nb2)
, d2 AS (SELECT series, n, b, rep, unnest(range(0, nblk)) AS blk FROM d)
, d3 AS (SELECT *, {sql_hash_int(str(SEED), 'series', 'rep', 'blk')} % n AS start FROM d2)
, d4 AS (SELECT *, unnest(range(0, b)) AS off FROM d3)
, d5 AS (SELECT series, rep, blk * b + off AS idx, (start + off) % n AS src FROM d4 WHERE blk * b + off < n)
SELECT d5.series, CAST(rep AS INTEGER) AS rep, CAST(d5.idx AS INTEGER) AS idx, src, s.value
FROM d5 JOIN s ON s.series = d5.series AND s.idx = d5.src""",
    "main_revenues"))(block_bootstrap)


STATIONARY_REPS, STATIONARY_LENGTH = 20, 7.0


def stationary_bootstrap(v: Views) -> DataFrame:
    return R.stationary_bootstrap(daily_series(v).select("series", "idx", "value"), STATIONARY_REPS, STATIONARY_LENGTH, SEED)


register("x06_stationary_bootstrap", floats={"value": 2}, oracle=with_views(_SERIES_SQL + f"""
, d AS (SELECT series, n, unnest(range(0, {STATIONARY_REPS})) AS rep FROM n)
, d2 AS (SELECT series, n, rep, unnest(range(0, n)) AS idx FROM d)
, d3 AS (SELECT *, idx = 0 OR {sql_hash_int(str(SEED), 'series', 'rep', 'idx', "'cut'")} * {STATIONARY_LENGTH} < 4294967296 AS fresh FROM d2)
, d4 AS (SELECT *, max(idx) FILTER (WHERE fresh) OVER (PARTITION BY series, rep ORDER BY idx) AS opened FROM d3)
, d5 AS (SELECT *, ({sql_hash_int(str(SEED), 'series', 'rep', 'opened', "'start'")} + idx - opened) % n AS src FROM d4)
SELECT d5.series, CAST(rep AS INTEGER) AS rep, CAST(d5.idx AS INTEGER) AS idx, src, s.value
FROM d5 JOIN s ON s.series = d5.series AND s.idx = d5.src""", "main_revenues"))(stationary_bootstrap)


def holdout(v: Views) -> DataFrame:
    """X-8 on the paid/organic daily table: 15 % test days per platform."""
    d = I.paid_organic_daily(v).withColumn("day_key", F.date_format("dt", "yyyy-MM-dd"))
    return R.holdout_split(d, ["platform"], "day_key", 0.15, SEED).drop("day_key")


register("x04_holdout_split", oracle=with_views(I._PO_SQL + f"""
, hs AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY
                    {sql_hash_int(str(SEED), 'platform', "strftime(dt, '%Y-%m-%d')")}, strftime(dt, '%Y-%m-%d')) AS r,
                count(*) OVER (PARTITION BY platform) AS n FROM po)
SELECT dt, platform, paid, organic, r <= ceil(n * 0.15) AS is_test FROM hs""", "installs"))(holdout)


# --------------------------------------------------------------------- T-2
LOESS_Q = 31


def loess_native(v: Views, q: int = LOESS_Q) -> DataFrame:
    """T-2: LOESS (degree 1, tricube, q nearest days) of each daily series
    in native columns: every day explodes its q-day window (shifted at the
    ends), neighbours are fetched by an equi join on (series, idx), and the
    local line comes from grouped weighted sums.  Rows = series x days x q."""
    s = daily_series(v).select("series", "idx", "value")
    n = s.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    c = s.join(n, "series").withColumn("st", F.greatest(F.least(E("idx") - (q - 1) // 2, E("n") - q), F.lit(0)))
    c = c.withColumn("j", F.explode(F.sequence(E("st"), F.least(E("st") + q, E("n")) - 1)))
    c = c.withColumn("h", F.greatest(E("idx") - E("st"), F.least(E("st") + q, E("n")) - 1 - E("idx")))
    nb = s.select("series", E("idx").alias("j"), E("value").alias("yj"))
    d = c.select("series", "idx", "j", "h").join(nb, ["series", "j"])
    u = F.least(F.abs(E("j") - E("idx")) / F.greatest(E("h"), F.lit(1e-12)), F.lit(1.0))
    d = d.withColumn("w", F.pow(1 - F.pow(u, 3), 3)).withColumn("x", (E("j") - E("idx")).cast("double"))
    g = d.groupBy("series", "idx").agg(
        F.sum("w").alias("s0"), F.sum(E("w") * E("x")).alias("s1"), F.sum(E("w") * E("x") * E("x")).alias("s2"),
        F.sum(E("w") * E("yj")).alias("t0"), F.sum(E("w") * E("x") * E("yj")).alias("t1"))
    den = E("s0") * E("s2") - E("s1") * E("s1")
    b = F.when(den > 1e-12, (E("s0") * E("t1") - E("s1") * E("t0")) / den).otherwise(0.0)
    return g.select("series", "idx", ((E("t0") - b * E("s1")) / E("s0")).alias("smoothed"))


register("t02_loess_native", floats={"smoothed": 4}, oracle=with_views(_SERIES_SQL + f"""
, c0 AS (SELECT s.series, s.idx, n.n, greatest(least(s.idx - {(LOESS_Q - 1) // 2}, n.n - {LOESS_Q}), 0) AS st
         FROM s JOIN n USING (series))
, c1 AS (SELECT series, idx, st, least(st + {LOESS_Q}, n) - 1 AS en FROM c0)
, c2 AS (SELECT series, idx, greatest(idx - st, en - idx) AS h, unnest(range(st, en + 1)) AS j FROM c1)
, d AS (SELECT c2.series, c2.idx, c2.j, c2.h, s.value AS yj FROM c2 JOIN s ON s.series = c2.series AND s.idx = c2.j)
, d2 AS (SELECT *, pow(1 - pow(least(abs(j - idx) / greatest(h, 1e-12), 1.0), 3), 3) AS w,
                CAST(j - idx AS DOUBLE) AS x FROM d)
, g AS (SELECT series, idx, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * yj) AS t0,
               sum(w * x * yj) AS t1 FROM d2 GROUP BY 1, 2)
SELECT series, idx,
       (t0 - CASE WHEN s0 * s2 - s1 * s1 > 1e-12 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) ELSE 0 END * s1) / s0
         AS smoothed
FROM g""", "main_revenues"))(loess_native)
