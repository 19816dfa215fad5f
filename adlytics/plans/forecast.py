"""Revenue forecast: decomposition, replicates, Holt-Winters, band, backtests
(T-1, T-3 .. T-9, X-4, C-27 .. C-30).

Group, metric, cut-off and replicate are keys of one job.  Raw rows are summed to days
first; everything behind that grows with keys x days.  The registered forecasts
decompose in one pass without outlier weights, so that SQL can check them;
``t01_stl_robust`` has the weights.  All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlytics.functions.compat import half_even
from adlytics.functions.draws import sql_hash_int
from adlytics.operators.reshape import fill_calendar
from adlytics.operators.resample import replicate_arrays
from adlytics.operators.seasonal import Seasons, as_arrays, decompose, decompose_arrays
from adlytics.operators.smoothing import GRID, band, candidates, holt_winters, horizon, predicted
from adlytics.oracle.views import with_views
from adlytics.plans.registry import register
from adlytics.plans.resampling import _SERIES_SQL, daily_series
from adlytics.plans.revenue import revenue_input
from adlytics.sources.views import Views

E = F.col

METRICS = {"booking_revenues": "est_revenue_before_cancellations", "booking_revenues_after_cancellations": "est_revenue"}
GROUP_MARK = "EUROPE"
MIN_ROWS = 720
SEED = 42
ONE_PASS = Seasons(period=365, season=13, inner=1, outer=0)
ROBUST = Seasons(period=365, season=13, inner=1, outer=5)
CUTOFF = "1998-06-10"
CUTOFFS = ("1997-07-10", "1997-07-15", "1997-11-07", "1997-11-15", "1997-12-04", "1997-12-10", "1997-12-15",
           "1998-01-05", "1998-02-04", "1998-02-10", "1998-02-15", "1998-06-04", "1998-06-10", "1998-06-15")
SWEEP_REPS, GROUP_REPS, IID_REPS = 9, 5, 20
YEAR, WEEK = 365, 7


# ------------------------------------------------------------------ SQL of the steps

def stl_sql(s: Seasons) -> str:
    """One unweighted inner pass over ser(series, idx, value): dec(series, idx,
    value, trend, season, residual)."""
    p, q = s.period, s.season

    def line(points: str, out: str, keys: str, scale: str) -> str:
        # points: keys, d (distance to the place), reach, v
        return f"""
, {out}_w AS (SELECT *, abs(d) / greatest(reach, 1e-9) AS far FROM {points})
, {out}_k AS (SELECT *, CASE WHEN far <= 0.001 THEN 1.0 WHEN far <= 0.999 THEN pow(1 - far * far * far, 3) ELSE 0 END AS k FROM {out}_w)
, {out}_s AS (SELECT {keys}, any_value({scale}) AS scale, sum(k) AS s0, sum(k * d) AS s1, sum(k * d * d) AS s2, sum(k * v) AS t0, sum(k * d * v) AS t1
              FROM {out}_k GROUP BY ALL)
, {out} AS (SELECT {keys}, t0 / s0 - CASE WHEN s2 - s1 * s1 / s0 > s0 * pow(0.001 * (scale - 1), 2)
              THEN (t1 - s1 * t0 / s0) / (s2 - s1 * s1 / s0) * s1 / s0 ELSE 0 END AS v FROM {out}_s)"""

    def smooth(source: str, out: str, window: int) -> str:
        jump = s.jump_of(window)
        return f"""
, {out}_x AS (SELECT series, n, unnest(range(CAST(ceil((n - 1) / {jump}) AS BIGINT) + 1)) AS knot FROM nn)
, {out}_y AS (SELECT *, least(knot * {jump}, n - 1) AS x FROM {out}_x)
, {out}_b AS (SELECT *, greatest(least(x - {(window - 1) // 2}, n - {window}), 0) AS a FROM {out}_y)
, {out}_c AS (SELECT *, least(a + {window}, n) - 1 AS z FROM {out}_b)
, {out}_d AS (SELECT *, greatest(x - a, z - x) + CASE WHEN n < {window} THEN ({window} - n) // 2 ELSE 0 END AS reach FROM {out}_c)
, {out}_p AS (SELECT c.series, c.knot, c.n, c.reach, CAST(y.idx - c.x AS DOUBLE) AS d, y.v
              FROM {out}_d c JOIN {source} y ON y.series = c.series AND y.idx BETWEEN c.a AND c.z)
{line(out + "_p", out + "_l", "series, knot", "n")}
, {out} AS (SELECT e.series, e.idx, l.v + CASE WHEN e.idx % {jump} = 0 THEN 0 ELSE
                (r.v - l.v) * (e.idx - l.knot * {jump}) / (least((l.knot + 1) * {jump}, nn.n - 1) - l.knot * {jump}) END AS v
            FROM ser e JOIN nn USING (series) JOIN {out}_l l ON l.series = e.series AND l.knot = e.idx // {jump}
            LEFT JOIN {out}_l r ON r.series = e.series AND r.knot = l.knot + 1)"""

    def average(source: str, out: str, width: int) -> str:
        return f"""
, {out}_a AS (SELECT series, i, avg(v) OVER w AS v, count(*) OVER w AS c FROM {source}
              WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))
, {out} AS (SELECT series, i, v FROM {out}_a WHERE c = {width})"""

    return f"""
, nn AS (SELECT series, count(*) AS n FROM ser GROUP BY 1)
, c_i AS (SELECT series, n, unnest(range(-{p}, n + {p})) AS i FROM nn)
, c_k AS (SELECT *, ((i % {p}) + {p}) % {p} AS k FROM c_i)
, c_x AS (SELECT *, CASE WHEN i < 0 THEN -1 ELSE i // {p} END AS x, (n - 1 - k) // {p} + 1 AS m FROM c_k)
, c_a AS (SELECT *, greatest(least(x - {(q - 1) // 2}, m - {q}), 0) AS a FROM c_x)
, c_z AS (SELECT *, least(a + {q}, m) - 1 AS z FROM c_a)
, c_r AS (SELECT *, greatest(x - a, z - x) + CASE WHEN m < {q} THEN ({q} - m) // 2 ELSE 0 END AS reach, unnest(range(a, z + 1)) AS j FROM c_z)
, c_p AS (SELECT r.series, r.i, r.m, r.reach, CAST(r.j - r.x AS DOUBLE) AS d, CAST(y.value AS DOUBLE) AS v
          FROM c_r r JOIN ser y ON y.series = r.series AND y.idx = r.k + r.j * {p})
{line("c_p", "cyc", "series, i", "m")}
{average("cyc", "ma1", p)}{average("ma1", "ma2", p)}{average("ma2", "ma3", 3)}
, low_in AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY i) - 1 AS idx, v FROM ma3)
{smooth("low_in", "low", s.low_pass_window())}
, sea AS (SELECT y.series, y.idx, y.value, c.v - l.v AS season
          FROM ser y JOIN cyc c ON c.series = y.series AND c.i = y.idx JOIN low l ON l.series = y.series AND l.idx = y.idx)
, rest AS (SELECT series, idx, value - season AS v FROM sea)
{smooth("rest", "tre", s.trend_window())}
, dec AS MATERIALIZED (SELECT s.series, s.idx, s.value, t.v AS trend, s.season, s.value - t.v - s.season AS residual
          FROM sea s JOIN tre t ON t.series = s.series AND t.idx = s.idx)"""


def replicate_sql(reps: int, blocks: bool) -> str:
    """boot(series, rep, idx, value) from dec."""
    return f"""
, b_n AS (SELECT series, n, {"CAST(floor(pow(n, 0.2)) AS BIGINT)" if blocks else "1"} AS b, unnest(range({reps})) AS rep FROM nn)
, b_i AS (SELECT *, unnest(range(n)) AS idx FROM b_n)
, b_s AS (SELECT *, ({sql_hash_int(str(SEED), 'series', 'rep', 'idx // b')} % n + idx % b) % n AS src FROM b_i)
, b_v AS (SELECT s.series, s.rep, s.idx, d.trend + d.season + r.residual AS value
          FROM b_s s JOIN dec d ON d.series = s.series AND d.idx = s.idx JOIN dec r ON r.series = s.series AND r.idx = s.src)
, boot AS (SELECT * FROM b_v QUALIFY max(value) OVER (PARTITION BY series, rep) >= 0)"""


def smoothing_sql(period: int) -> str:
    """fc(series, rep, date, prediction) from train(series, rep, idx, value) and
    span(series, first, last)."""
    p = period
    listed = ", ".join(f"({i}, {a}, {b}, {c}, {f})" for i, (a, b, c, f) in enumerate(candidates(GRID)))
    level = "al * (x[1] - s[4]) + (1 - al) * (s[1] + ph * s[2])"
    miss = "(x[1] - s[1] - ph * s[2] - s[4])"
    return f"""
, cand(no, al, be, ga, ph) AS (SELECT CAST(c0 AS BIGINT), CAST(c1 AS DOUBLE), CAST(c2 AS DOUBLE), CAST(c3 AS DOUBLE), CAST(c4 AS DOUBLE) FROM (VALUES {listed}) t(c0, c1, c2, c3, c4))
, h_y AS (SELECT series, rep, list(CAST(value AS DOUBLE) ORDER BY idx) AS ys FROM train GROUP BY 1, 2 HAVING count(*) >= {2 * p})
, h_m AS (SELECT *, list_sum(ys[1:{p}]) / {p} AS a, (list_sum(ys[{p + 1}:{2 * p}]) - list_sum(ys[1:{p}])) / {p} / {p} AS slope FROM h_y)
, h_0 AS (SELECT series, rep, ys, list_concat([a + slope * {(p - 1) / 2}, slope, CAST(0 AS DOUBLE)],
              list_transform(range({p}), lambda i: ys[i + 1] - a - slope * (i - {(p - 1) / 2}))) AS state FROM h_m)
, h_f AS (SELECT series, rep, no, ph, list_reduce(list_transform(ys[{p + 1}:], lambda v: [v]), lambda s, x: list_concat(
              [{level}, be * ({level} - s[1]) + (1 - be) * ph * s[2], s[3] + {miss} * {miss}], s[5:], [ga * (x[1] - s[1] - ph * s[2]) + (1 - ga) * s[4]]),
              state) AS s FROM h_0, cand)
, fit AS (SELECT * FROM h_f QUALIFY row_number() OVER (PARTITION BY series, rep ORDER BY s[3], no) = 1)
, fc_d AS (SELECT f.*, CAST(unnest(generate_series(b.first, b.last, INTERVAL 1 DAY)) AS DATE) AS date, b.first FROM fit f JOIN span b USING (series))
, fc_h AS (SELECT *, datediff('day', first, date) + 1 AS h FROM fc_d)
, fc AS (SELECT series, rep, date, s[1] + ph * (1 - pow(ph, h)) / (1 - ph) * s[2] + s[4 + (h - 1) % {p}] AS prediction FROM fc_h)"""


BAND_SQL = """
, band AS (SELECT series, date, avg(prediction) AS mean, avg(prediction) - stddev_samp(prediction) AS lower,
                  avg(prediction) + stddev_samp(prediction) AS upper FROM fc GROUP BY 1, 2)"""


# ------------------------------------------------------------------ T-1, X-4

_SER_SQL = _SERIES_SQL.replace(", s AS (", ", ser_all AS (").replace("FROM s GROUP BY 1)", "FROM ser_all GROUP BY 1)") + """
, ser AS (SELECT ser_all.* FROM ser_all JOIN n USING (series) WHERE n.n >= 730)"""


def seasons(v: Views, s: Seasons = ONE_PASS) -> DataFrame:
    """T-1 of the daily revenue of every region."""
    rows = daily_series(v).select("series", "idx", "value")
    return decompose(rows, ["series"], s, tasks=v.spark.sparkContext.defaultParallelism).drop("weight")


register("t01_stl", floats={c: 3 for c in ("value", "trend", "season", "residual")},
         oracle=with_views(_SER_SQL + stl_sql(ONE_PASS) + "\nSELECT series, CAST(idx AS INTEGER) AS idx, CAST(value AS DOUBLE) AS value, trend, season, residual FROM dec",
                           "main_revenues"))(seasons)


def seasons_robust(v: Views) -> DataFrame:
    rows = daily_series(v).select("series", "idx", "value")
    return decompose(rows, ["series"], ROBUST, tasks=v.spark.sparkContext.defaultParallelism)


register("t01_stl_robust", note="tests: equals a plain version")(seasons_robust)


def region_parts(v: Views) -> DataFrame:
    rows = daily_series(v).select("series", "idx", "value")
    return decompose_arrays(as_arrays(rows, ["series"]), ONE_PASS, v.spark.sparkContext.defaultParallelism)


def residual_bootstrap(v: Views) -> DataFrame:
    """X-4, J-9, P-19: replicates of every region by circular blocks of residuals."""
    reps = replicate_arrays(region_parts(v), ["series"], GROUP_REPS, SEED)
    return reps.select("series", "rep", F.posexplode("ys").alias("idx", "value"))


register("x05_residual_bootstrap", floats={"value": 3}, oracle=with_views(
    _SER_SQL + stl_sql(ONE_PASS) + replicate_sql(GROUP_REPS, True)
    + "\nSELECT series, CAST(rep AS INTEGER) AS rep, CAST(idx AS INTEGER) AS idx, value FROM boot", "main_revenues"))(residual_bootstrap)


def replicate_check(v: Views) -> DataFrame:
    """C-30: the mean of IID replicates beside the actual value of each day."""
    parts = region_parts(v)
    reps = replicate_arrays(parts, ["series"], IID_REPS, SEED, blocks=False)
    mean = reps.select("series", F.posexplode("ys").alias("idx", "value")).groupBy("series", "idx").agg(F.avg("value").alias("mean"))
    actual = daily_series(v).select("series", "idx", "date", E("value").cast("double").alias("actual"))
    return actual.join(mean, ["series", "idx"]).select("series", "date", "mean", "actual")


register("c30_bootstrap_check", floats={"mean": 3, "actual": 3}, oracle=with_views(
    _SER_SQL + stl_sql(ONE_PASS) + replicate_sql(IID_REPS, False) + """
, m AS (SELECT series, idx, avg(value) AS mean FROM boot GROUP BY 1, 2)
SELECT ser.series, ser.date, m.mean, CAST(ser.value AS DOUBLE) AS actual FROM ser JOIN m ON m.series = ser.series AND m.idx = ser.idx""",
    "main_revenues"))(replicate_check)


# ------------------------------------------------------------------ T-3, T-4, C-28, C-29

def _spans(rows: DataFrame, mode: str) -> DataFrame:
    """series, start, first, last: the days to predict (T-4); ``start`` is day 0."""
    d = rows.groupBy("series").agg(F.min("date").alias("start"), F.max("date").alias("_hi")).withColumn("h", horizon(E("_hi"), mode))
    return d.select("series", "start", "h.first", "h.last")


def _span_sql(source: str, mode: str) -> str:
    first = "max(date)" if mode == "cutoff" else "CAST(date_trunc('month', max(date)) AS DATE)"
    return f"\n, span AS (SELECT series, min(date) AS start, {first} AS first, last_day(max(date)) AS last FROM {source} GROUP BY 1)"


def forecast(arrays: DataFrame, spans: DataFrame, keys: list[str], period: int) -> DataFrame:
    """keys, date, prediction: T-3 on the days before the first one to predict."""
    rows = arrays.join(spans, "series")
    train = F.slice("ys", F.lit(1), F.datediff("first", "start"))
    fits = holt_winters(rows.select(*keys, train.alias("ys")), keys, period)
    return predicted(fits.join(spans, "series"), keys, "first", "last", period)


def holt_winters_regions(v: Views) -> DataFrame:
    """T-3 / T-4 on every region's days themselves: weekly season, whole last month."""
    rows = daily_series(v)
    arrays = as_arrays(rows.select("series", "idx", "value"), ["series"])
    return forecast(arrays, _spans(rows, "month_start"), ["series"], WEEK)


register("t03_holt_winters", floats={"prediction": 2}, oracle=with_views(
    _SERIES_SQL + _span_sql("s", "month_start")
    + "\n, train AS (SELECT s.series, 0 AS rep, s.idx, s.value FROM s JOIN span USING (series) WHERE s.date < span.first)"
    + smoothing_sql(WEEK) + "\nSELECT series, date, prediction FROM fc", "main_revenues"))(holt_winters_regions)


def iid_predictions(v: Views) -> DataFrame:
    """T-5: every IID replicate of every region forecast by itself, weekly season."""
    reps = replicate_arrays(region_parts(v), ["series"], IID_REPS, SEED, blocks=False)
    return forecast(reps, _spans(daily_series(v), "month_start"), ["series", "rep"], WEEK)


_IID_SQL = (_SER_SQL + stl_sql(ONE_PASS) + replicate_sql(IID_REPS, False) + _span_sql("ser", "month_start") + """
, train AS (SELECT b.series, b.rep, b.idx, b.value FROM boot b JOIN span USING (series) WHERE b.idx < datediff('day', span.start, span.first))"""
            + smoothing_sql(WEEK))


def iid_forecast(v: Views) -> DataFrame:
    """C-28, T-6: the band of those forecasts by day."""
    return band(iid_predictions(v), ["series", "date"], "prediction")


register("c28_iid_forecast", floats={"mean": 2, "lower": 2, "upper": 2}, oracle=with_views(
    _IID_SQL + BAND_SQL + "\nSELECT series, date, mean, lower, upper FROM band", "main_revenues"))(iid_forecast)


def _actuals(v: Views) -> DataFrame:
    """Actual revenue by region and day, whole table."""
    return (revenue_input(v).groupBy(E("site_global_region").alias("series"), "date")
            .agg(F.sum("booking_revenues").alias("actual")))


def iid_evaluation(v: Views) -> DataFrame:
    """C-29, W-12: the band and the actual revenue, each summed up over the month."""
    rows = iid_forecast(v).join(_actuals(v), ["series", "date"], "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    w = Window.partitionBy("series").orderBy("date")  # the days of a month
    return rows.select("series", "date", *[F.sum(c).over(w).alias(f"cum_{c}") for c in ("mean", "lower", "upper", "actual")])


register("c29_forecast_evaluation", floats={f"cum_{c}": 2 for c in ("mean", "lower", "upper", "actual")}, oracle=with_views(
    _IID_SQL + BAND_SQL + """
, act AS (SELECT site_global_region AS series, date, sum(est_revenue_before_cancellations) AS actual FROM main_revenues GROUP BY 1, 2)
SELECT b.series, b.date, sum(mean) OVER w AS cum_mean, sum(lower) OVER w AS cum_lower, sum(upper) OVER w AS cum_upper,
       sum(coalesce(actual, 0)) OVER w AS cum_actual
FROM band b LEFT JOIN act a ON a.series = b.series AND a.date = b.date
WINDOW w AS (PARTITION BY b.series ORDER BY b.date)""", "main_revenues"))(iid_evaluation)


def replicate_totals(v: Views) -> DataFrame:
    """A-15: each replicate's predicted total, and the mean of these of its region."""
    totals = iid_predictions(v).groupBy("series", "rep").agg(F.sum("prediction").alias("total"))
    mean = totals.groupBy("series").agg(F.avg("total").alias("mean_total"))
    return totals.join(mean, "series")


register("c29_replicate_totals", floats={"total": 2, "mean_total": 2}, oracle=with_views(_IID_SQL + """
, t AS (SELECT series, rep, sum(prediction) AS total FROM fc GROUP BY 1, 2)
SELECT series, CAST(rep AS INTEGER) AS rep, total, avg(total) OVER (PARTITION BY series) AS mean_total FROM t""", "main_revenues"))(replicate_totals)


# ------------------------------------------------------------------ T-7 .. T-9, C-27

def group_days(v: Views, metrics: list[str], mark: str = GROUP_MARK) -> DataFrame:
    """grp, date, metric, value, rows: daily sums of the groups (a region, and its deal
    types) whose name holds ``mark`` (P-21), metrics stacked."""
    r = revenue_input(v)
    names = F.array(E("site_global_region"), F.concat_ws(" | ", "site_global_region", "deal_type"))
    r = r.select("date", F.explode(names).alias("grp"), *metrics).filter(E("grp").contains(mark))
    d = r.groupBy("grp", "date").agg(*[half_even(F.sum(m), 0).alias(m) for m in metrics], F.count(F.lit(1)).alias("rows"))
    # a row a day: what follows reads it several times
    return d.unpivot(["grp", "date", "rows"], metrics, "metric", "value").checkpoint()


def cut_series(v: Views, metrics: list[str], cutoffs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Days before each cut-off as gap-free series (series, date, idx, value), and the
    status of each: P-20 skips groups of at most MIN_ROWS rows, and less than two
    seasons cannot be decomposed."""
    d = group_days(v, metrics).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    d = d.filter(E("date") < E("cutoff").cast("date"))
    keys = ["grp", "metric", "cutoff"]
    d = d.withColumn("series", F.concat_ws("|", *keys))
    state = d.groupBy("series", *keys).agg(F.sum("rows").alias("rows"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    state = state.withColumn("status", F.when(E("rows") <= MIN_ROWS, "too few rows").when(E("days") <= 2 * YEAR, "too few days").otherwise("ok"))
    good = d.join(state.filter("status = 'ok'").select("series"), "series", "left_semi").select("series", "date", "value")
    good = fill_calendar(good, ["series"], "date", ["value"])
    place = Window.partitionBy("series").orderBy("date")
    return good.withColumn("idx", F.row_number().over(place) - 1), state


def block_forecasts(v: Views, metrics: list[str], cutoffs: list[str], reps: int) -> tuple[DataFrame, DataFrame]:
    """series, date, mean, lower, upper of all groups, metrics and cut-offs; and the states."""
    rows, state = cut_series(v, metrics, cutoffs)
    parts = decompose_arrays(as_arrays(rows.select("series", "idx", "value"), ["series"]), ONE_PASS, v.spark.sparkContext.defaultParallelism)
    found = forecast(replicate_arrays(parts, ["series"], reps, SEED), _spans(rows, "cutoff"), ["series", "rep"], YEAR)
    return band(found, ["series", "date"], "prediction"), state


def _cut_sql(metrics: list[str], cutoffs: list[str], reps: int) -> str:
    stacked = " UNION ALL ".join(f"SELECT grp, date, '{m}' AS metric, {m} AS v, rows FROM g1" for m in metrics)
    sums = ", ".join(f"round_even(sum({METRICS[m]}), 0) AS {m}" for m in metrics)
    return f"""
, g0 AS (SELECT *, unnest([site_global_region, concat_ws(' | ', site_global_region, deal_type)]) AS grp FROM main_revenues)
, g1 AS (SELECT grp, date, {sums}, count(*) AS rows FROM g0 WHERE contains(grp, '{GROUP_MARK}') GROUP BY 1, 2)
, g2 AS ({stacked})
, g3 AS (SELECT concat_ws('|', grp, metric, cutoff) AS series, * FROM g2, (SELECT unnest([{", ".join(f"'{c}'" for c in cutoffs)}]) AS cutoff)
         WHERE date < CAST(cutoff AS DATE))
, state0 AS (SELECT series, grp, metric, cutoff, CAST(sum(rows) AS BIGINT) AS rows, min(date) AS lo, max(date) AS hi FROM g3 GROUP BY ALL)
, state AS (SELECT *, CASE WHEN rows <= {MIN_ROWS} THEN 'too few rows' WHEN datediff('day', lo, hi) + 1 <= {2 * YEAR} THEN 'too few days' ELSE 'ok' END AS status FROM state0)
, cal AS (SELECT series, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM state WHERE status = 'ok')
, ser AS MATERIALIZED (SELECT c.series, c.date, datediff('day', c.lo, c.date) AS idx, coalesce(g.v, 0) AS value FROM cal c LEFT JOIN g3 g ON g.series = c.series AND g.date = c.date)
{stl_sql(ONE_PASS)}{replicate_sql(reps, True)}{_span_sql("ser", "cutoff")}
, train AS (SELECT b.series, b.rep, b.idx, b.value FROM boot b JOIN span USING (series) WHERE b.idx < datediff('day', span.start, span.first))
{smoothing_sql(YEAR)}{BAND_SQL}"""


# column, its source, its metric
_WIDE = [(f"{name}_{m}", c, m) for c, name in (("mean", "predicted"), ("lower", "lower"), ("upper", "upper")) for m in METRICS]


def forecast_groups(v: Views) -> DataFrame:
    """T-7, J-8, U-3: groups x metrics at one cut-off, the metrics side by side by
    date; a group that is skipped is a row with its status."""
    metrics = list(METRICS)
    found, state = block_forecasts(v, metrics, [CUTOFF], GROUP_REPS)
    rows = state.select("series", "grp", "metric", "cutoff", "status").join(found, "series", "left")
    return rows.groupBy("grp", "cutoff", "status", "date").agg(
        *[F.max(F.when(E("metric") == m, E(c))).alias(n) for n, c, m in _WIDE])


register("c27_forecast_groups", floats={n: 2 for n, _, _ in _WIDE}, oracle=with_views(
    _cut_sql(list(METRICS), [CUTOFF], GROUP_REPS) + f"""
SELECT grp, cutoff, status, date, {", ".join(f"max({c}) FILTER (WHERE metric = '{m}') AS {n}" for n, c, m in _WIDE)}
FROM state LEFT JOIN band USING (series) GROUP BY ALL""", "main_revenues"))(forecast_groups)


def backtest(v: Views, cutoffs: tuple[str, ...] = CUTOFFS) -> DataFrame:
    """T-8, T-9: for all cut-offs in one job the actual days of the month before the cut-off
    and the forecast from its last known day on (U-2: that day is in both, as in the
    original), beside the actual revenue (J-10) and summed up by date (W-12)."""
    metric = next(iter(METRICS))
    found, state = block_forecasts(v, [metric], list(cutoffs), SWEEP_REPS)
    keys = state.filter("status = 'ok'").select("series", "grp", "cutoff")
    ahead = found.join(keys, "series").select("grp", "cutoff", "date", F.lit("forecast").alias("part"), E("mean").alias("predicted"), "lower", "upper")
    # actual days, not rounded
    names = F.array(E("site_global_region"), F.concat_ws(" | ", "site_global_region", "deal_type"))
    actual = (revenue_input(v).select("date", F.explode(names).alias("grp"), metric).filter(E("grp").contains(GROUP_MARK))
              .groupBy("grp", "date").agg(F.sum(metric).alias("actual")))
    known = keys.withColumn("date", F.explode(F.sequence(F.trunc(E("cutoff").cast("date"), "month"), F.date_sub(E("cutoff").cast("date"), 1))))
    known = known.join(actual, ["grp", "date"], "left").select("grp", "cutoff", "date", F.lit("actual").alias("part"), *[
        E("actual").alias(c) for c in ("predicted", "lower", "upper")])
    rows = known.unionByName(ahead).join(actual, ["grp", "date"], "left")
    w = Window.partitionBy("grp", "cutoff").orderBy("date", "part")  # the days of a month
    return rows.select("grp", "cutoff", "date", "part", "predicted", "lower", "upper", "actual",
                       *[F.sum(c).over(w).alias(f"cum_{c}") for c in ("predicted", "lower", "upper", "actual")])


_BACK_FLOATS = {c: 2 for x in ("predicted", "lower", "upper", "actual") for c in (x, f"cum_{x}")}
_BACK_SQL = _cut_sql(list(METRICS)[:1], list(CUTOFFS), SWEEP_REPS) + """
, act AS (SELECT grp, date, sum(est_revenue_before_cancellations) AS actual FROM g0 GROUP BY 1, 2)
, known AS (SELECT grp, cutoff, CAST(unnest(generate_series(date_trunc('month', CAST(cutoff AS DATE)), CAST(cutoff AS DATE) - 1, INTERVAL 1 DAY)) AS DATE) AS date
            FROM state WHERE status = 'ok')
, parts AS (SELECT k.grp, k.cutoff, k.date, 'actual' AS part, a.actual AS predicted, a.actual AS lower, a.actual AS upper
            FROM known k LEFT JOIN act a ON a.grp = k.grp AND a.date = k.date
            UNION ALL SELECT s.grp, s.cutoff, b.date, 'forecast', b.mean, b.lower, b.upper FROM band b JOIN state s USING (series))
, back AS (SELECT p.*, a.actual, sum(predicted) OVER w AS cum_predicted, sum(lower) OVER w AS cum_lower, sum(upper) OVER w AS cum_upper,
                  sum(a.actual) OVER w AS cum_actual
           FROM parts p LEFT JOIN act a ON a.grp = p.grp AND a.date = p.date WINDOW w AS (PARTITION BY p.grp, p.cutoff ORDER BY p.date, p.part))"""
register("c27_backtest", floats=_BACK_FLOATS, oracle=with_views(_BACK_SQL + "\nSELECT * FROM back", "main_revenues"))(backtest)


def backtest_summary(v: Views) -> DataFrame:
    """T-8, A-14: by cut-off the predicted and actual sums, and their relative difference."""
    g = backtest(v).groupBy("grp", "cutoff").agg(F.sum("predicted").alias("predicted_sum"), F.sum("actual").alias("actual_sum"))
    whole = E("actual_sum").cast("long")
    return g.withColumn("diff", F.try_divide(E("predicted_sum").cast("long") - whole, whole))


register("c27_backtest_summary", floats={"predicted_sum": 2, "actual_sum": 2, "diff": 2}, oracle=with_views(_BACK_SQL + """
, sums AS (SELECT grp, cutoff, sum(predicted) AS predicted_sum, sum(actual) AS actual_sum FROM back GROUP BY 1, 2)
SELECT *, (trunc(predicted_sum) - trunc(actual_sum)) / nullif(trunc(actual_sum), 0) AS diff FROM sums""", "main_revenues"))(backtest_summary)
