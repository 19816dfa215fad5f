"""Bayesian A/B test of two conversion rates (Beta-Binomial, B-1 .. B-14).

Input: a day-level table with one row per (arm, date) holding the sample
size n and the conversions k of that day.  The raw events are reduced to
that table by an aggregate first, so everything here scales with the
number of days (and experiments), never with the number of events.

Posterior on day d (0-based, in date order per arm): Beta(alpha + K_d,
beta + N_d - K_d) with N_d, K_d the running sums up to day d.

Quantities by deterministic quadrature on a grid of ``grid`` midpoints
shared by both arms (from the smaller mean - 10 sd to the larger mean +
10 sd, clipped to (0, 1)); densities are normalised on the grid:

* P(variant >= control) = sum_i pv_i * Fc(x_i)
* expected loss of keeping control  = E[max(v - c, 0)]
  = sum_i pv_i * (x_i Fc(x_i) - Mc(x_i))   (Mc = partial first moment)
* expected loss of choosing variant = E[max(c - v, 0)], the mirror image
* equal-tailed 95 % interval from the grid CDF, linear inside a cell.

The running CDF is a window partitioned by day, so one day's grid is one
window partition (``grid`` rows) whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlytics.functions.draws import fast_uniform

E = F.col


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A few rows that are about to be exploded, dealt to as many tasks as a
    shuffle has (an explicit count, which adaptive coalescing leaves alone)."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def daily_arms(df: DataFrame, test_col: str, date_col: str, n_col: str, k_col: str,
               control: str, variant: str) -> DataFrame:
    """B-1: per arm and date the sample size and conversions, with the
    0-based day index per arm (W-14) and the weekday name."""
    d = (df.filter(E(test_col).isin(control, variant))
           .groupBy(F.when(E(test_col) == control, "control").otherwise("variant").alias("arm"),
                    E(date_col).alias("date"))
           .agg(F.sum(n_col).alias("n"), F.sum(k_col).alias("k")))
    w = Window.partitionBy("arm").orderBy("date")
    return d.withColumns({"day": F.row_number().over(w) - 1, "week_day": F.date_format("date", "EEEE")})


def posterior_params(daily: DataFrame, alpha: float = 1.0, beta: float = 1.0, days: int | None = None) -> DataFrame:
    """B-2/B-3: one row per day with both arms' Beta parameters, mean and
    variance, for days 0 .. min(days, days of the shorter arm) - 1."""
    w = Window.partitionBy("arm").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = daily.withColumns({"N": F.sum("n").over(w), "K": F.sum("k").over(w)})
    c = c.withColumns({"a": F.lit(float(alpha)) + E("K"), "b": F.lit(float(beta)) + E("N") - E("K")})
    # one row per day with both arms side by side: a conditional aggregate
    # (one pass, no self join); days present in both arms only
    cols = ("date", "N", "K", "a", "b")
    j = (c.groupBy("day")
          .agg(*[F.max(F.when(E("arm") == arm, E(x))).alias(f"{x}_{p}")
                 for arm, p in (("control", "c"), ("variant", "v")) for x in cols])
          .filter(E("a_c").isNotNull() & E("a_v").isNotNull()))
    if days is not None:
        j = j.filter(E("day") < days)
    for p in ("c", "v"):
        a, b = E(f"a_{p}"), E(f"b_{p}")
        j = j.withColumns({f"mean_{p}": a / (a + b),
                           f"var_{p}": a * b / ((a + b) * (a + b) * (a + b + 1))})
    return j


def _log_kernel(x: Column, a: Column, b: Column) -> Column:
    return (a - 1) * F.ln(x) + (b - 1) * F.log1p(-x)


def quadrature(post: DataFrame, grid: int = 20000, key: list[str] | None = None) -> DataFrame:
    """B-4/B-5/B-7 per day by quadrature (see module doc)."""
    key = (key or []) + ["day"]
    sd = lambda p: F.sqrt(E(f"var_{p}"))
    g = post.withColumns({
        "lo": F.greatest(F.least(E("mean_c") - 10 * sd("c"), E("mean_v") - 10 * sd("v")), F.lit(0.0)),
        "hi": F.least(F.greatest(E("mean_c") + 10 * sd("c"), E("mean_v") + 10 * sd("v")), F.lit(1.0))})
    from adlytics.functions.special import lbeta
    g = g.withColumns({"h": (E("hi") - E("lo")) / grid,
                       "lb_c": lbeta(E("a_c"), E("b_c")), "lb_v": lbeta(E("a_v"), E("b_v"))})   # per day, not per cell
    extra = [c for c in post.columns if c not in key and c not in ("a_c", "b_c", "a_v", "b_v")]
    pts = (spread(g, *key).select(*key, "lo", "h", "a_c", "b_c", "a_v", "b_v", "lb_c", "lb_v", *extra,
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
            .withColumn("x", E("lo") + (E("i") + 0.5) * E("h"))
            .withColumns({"lc": _log_kernel(E("x"), E("a_c"), E("b_c")),
                          "lv": _log_kernel(E("x"), E("a_v"), E("b_v"))}))
    # cell masses from the exact density: log kernel - log Beta(a, b) (no
    # window pass for a numerical normaliser; the grid covers +-10 sd)
    pts = pts.withColumns({"pc": F.exp(E("lc") - E("lb_c")) * E("h"),
                           "pv": F.exp(E("lv") - E("lb_v")) * E("h")})
    run = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    pts = pts.withColumns({"Ec": F.sum("pc").over(run), "Ev": F.sum("pv").over(run),
                           "Sc": F.sum(E("pc") * E("x")).over(run), "Sv": F.sum(E("pv") * E("x")).over(run)})
    # midpoint convention: a cell contributes half of itself to its own x
    pts = pts.withColumns({"Fc": E("Ec") - E("pc") / 2, "Fv": E("Ev") - E("pv") / 2,
                           "Mc": E("Sc") - E("pc") * E("x") / 2, "Mv": E("Sv") - E("pv") * E("x") / 2})

    def q(p: str, level: float) -> Column:
        # first cell whose right-edge CDF reaches the level; interpolate inside it
        # min over structs orders by the first field (the cell index); NULLs skipped
        return F.min(F.when(E(f"E{p}") >= level, F.struct("i", E(f"E{p}").alias("e"), E(f"p{p}").alias("m"),
                                                           "lo", "h")))

    carry = [c for c in post.columns if c not in key]
    mass = F.sum("pc") * F.sum("pv")
    agg = pts.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in carry if c in pts.columns],
        # divided by the grid masses, so that errors of the log Beta at large samples cancel
        (F.sum(E("pv") * E("Fc")) / mass).alias("prob_variant_better_than_control"),
        (F.sum(E("pv") * (E("x") * E("Fc") - E("Mc"))) / mass).alias("control_expected_loss"),
        (F.sum(E("pc") * (E("x") * E("Fv") - E("Mv"))) / mass).alias("variant_expected_loss"),
        *[q(p, lev).alias(f"_q_{p}_{nm}") for p in ("c", "v") for lev, nm in ((0.025, "lower"), (0.975, "upper"))])
    for p, arm in (("c", "control"), ("v", "variant")):
        for nm in ("lower", "upper"):
            s = E(f"_q_{p}_{nm}")
            lev = 0.025 if nm == "lower" else 0.975
            agg = agg.withColumn(f"{arm}_cvr_{nm}",
                                 s["lo"] + s["i"] * s["h"] + (F.lit(lev) - (s["e"] - s["m"])) / s["m"] * s["h"])
    return agg.drop(*[c for c in agg.columns if c.startswith("_q_")])


def bayes_by_day(daily: DataFrame, alpha: float = 1.0, beta: float = 1.0, days: int | None = None,
                 grid: int = 20000) -> DataFrame:
    """The per-day record: losses, probability, means and 95 % intervals."""
    post = posterior_params(daily, alpha, beta, days)
    qd = quadrature(post, grid)          # carries the per-day posterior columns
    return (qd
                .select("day", E("date_c").alias("date"),
                        "variant_expected_loss", "control_expected_loss", "prob_variant_better_than_control",
                        E("mean_c").alias("control_cvr"), "control_cvr_lower", "control_cvr_upper",
                        E("mean_v").alias("variant_cvr"), "variant_cvr_lower", "variant_cvr_upper",
                        E("N_c").alias("control_sample_size"), E("K_c").alias("control_conversions"),
                        E("N_v").alias("variant_sample_size"), E("K_v").alias("variant_conversions")))


def normal_draw(seed, *parts) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u1 = fast_uniform(seed, *parts, 1)
    u2 = fast_uniform(seed, *parts, 2)
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-300)))) * F.cos(2 * F.pi() * u2)


def log_normal_pdf(x: Column, m: Column, s: Column) -> Column:
    return -F.ln(s) - 0.5 * F.ln(2 * F.pi()) - 0.5 * ((x - m) / s) * ((x - m) / s)


def importance_sampling(post: DataFrame, n_draws: int = 500000, simulations: int = 1, seed: int = 0) -> DataFrame:
    """B-5/B-6/B-7/B-8 as in the original estimator: per day and simulation,
    ``n_draws`` pairs from Normal(mean, 1.25 sd) for each arm, weights
    f_c f_v / (g_c g_v) (0 outside (0, 1)), averages over the half planes.
    Draws are hash-based (seed, simulation, day, i), so the estimate is
    repeatable under any partitioning; rows = days x simulations x draws."""
    from adlytics.functions.special import lbeta
    # per-day constants first (one row per day), then the draws
    sims = (post.withColumn("simulation", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
                .withColumns({"sc": 1.25 * F.sqrt(E("var_c")), "sv": 1.25 * F.sqrt(E("var_v")),
                              "lb_c": lbeta(E("a_c"), E("b_c")), "lb_v": lbeta(E("a_v"), E("b_v"))}))
    # two-level explode (blocks of 1024) instead of one n_draws-long array per row
    blk = 1024
    d = (spread(sims.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((n_draws - 1) // blk)))), "simulation", "day", "_b")
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blk - 1))))
             .withColumn("i", E("_b") * blk + E("_o")).filter(E("i") < n_draws).drop("_b", "_o"))
    d = d.withColumns({"xc": E("mean_c") + E("sc") * normal_draw(seed, E("simulation"), E("day"), E("i"), "c"),
                       "xv": E("mean_v") + E("sv") * normal_draw(seed, E("simulation"), E("day"), E("i"), "v")})

    def lpdf(x, a, b, lb):
        return F.when((x > 0) & (x < 1), _log_kernel(x, a, b) - lb)

    lw = (lpdf(E("xc"), E("a_c"), E("b_c"), E("lb_c")) + lpdf(E("xv"), E("a_v"), E("b_v"), E("lb_v"))
          - log_normal_pdf(E("xc"), E("mean_c"), E("sc")) - log_normal_pdf(E("xv"), E("mean_v"), E("sv")))
    d = d.withColumn("y", F.coalesce(F.exp(lw), F.lit(0.0)))
    better = E("xv") >= E("xc")
    n = float(n_draws)
    return (d.groupBy("simulation", "day")
             .agg((F.sum(F.when(better, E("y")).otherwise(0.0)) / n).alias("prob_variant_better_than_control"),
                  (F.sum(F.when(better, E("y") * E("y")).otherwise(0.0)) / n).alias("_m2"),
                  (F.sum(F.when(better, (E("xv") - E("xc")) * E("y")).otherwise(0.0)) / n).alias("control_expected_loss"),
                  (F.sum(F.when(E("xc") >= E("xv"), (E("xc") - E("xv")) * E("y")).otherwise(0.0)) / n)
                  .alias("variant_expected_loss"))
             .withColumn("prob_variant_better_control_error",
                         F.sqrt(F.greatest(E("_m2") - E("prob_variant_better_than_control") ** 2, F.lit(0.0)))
                         / F.sqrt(F.lit(n)))
             .drop("_m2"))


def first_safe_day(by_day: DataFrame, eps: float = 0.0001) -> DataFrame:
    """B-12: first day each arm's expected loss is below ``eps``."""
    return by_day.agg(F.min(F.when(E("control_expected_loss") < eps, E("day"))).alias("first_day_control_safe"),
                      F.min(F.when(E("variant_expected_loss") < eps, E("day"))).alias("first_day_variant_safe"))


def verdict(by_day: DataFrame) -> DataFrame:
    """B-9: the last day's figures as a long (group, metric, value) table,
    formatted as in the original report."""
    last = by_day.agg(F.max_by(F.struct(*by_day.columns), "day").alias("r")).select("r.*")
    f5 = lambda c: F.format_string("%.5f", E(c))
    uplift = (E("variant_cvr") - E("control_cvr")) / E("control_cvr")
    wide = last.select(
        f5("control_cvr").alias("control__CvR"),
        E("control_sample_size").cast("string").alias("control__sample size"),
        E("control_conversions").cast("string").alias("control__conversions"),
        F.format_string("(%.5f, %.5f)", E("control_cvr_lower"), E("control_cvr_upper")).alias("control__95% credible interval"),
        f5("variant_cvr").alias("variant__CvR"),
        E("variant_sample_size").cast("string").alias("variant__sample size"),
        E("variant_conversions").cast("string").alias("variant__conversions"),
        F.format_string("(%.5f, %.5f)", E("variant_cvr_lower"), E("variant_cvr_upper")).alias("variant__95% credible interval"),
        F.format_string("%.3f%%", uplift * 100).alias("outcome__uplift"),
        F.format_string("%.8f", E("control_expected_loss")).alias("outcome__control expected loss"),
        F.format_string("%.8f", E("variant_expected_loss")).alias("outcome__variant expected loss"),
        F.format_string("%.3f%%", E("prob_variant_better_than_control") * 100).alias("outcome__prob (variant >= control)"))
    long = wide.unpivot([], wide.columns, "key", "value").filter(E("value").isNotNull())
    parts = F.split(E("key"), "__")
    return long.select(parts.getItem(0).alias("group"), parts.getItem(1).alias("metric"), "value")


def posterior_draws(post: DataFrame, n_draws: int = 5000, grid: int = 20000, seed: int = 0) -> DataFrame:
    """B-13: draws of both posteriors by inverse CDF on the quadrature grid
    (uniform hash draws located in the grid CDF by a range join on the
    cell's [F_lo, F_hi) bracket, bucketed on the CDF so the join is an
    equi-join), and the lift v - c per draw."""
    key = ["day"]
    g = post.withColumns({
        "lo_c": F.greatest(E("mean_c") - 10 * F.sqrt(E("var_c")), F.lit(0.0)),
        "hi_c": F.least(E("mean_c") + 10 * F.sqrt(E("var_c")), F.lit(1.0)),
        "lo_v": F.greatest(E("mean_v") - 10 * F.sqrt(E("var_v")), F.lit(0.0)),
        "hi_v": F.least(E("mean_v") + 10 * F.sqrt(E("var_v")), F.lit(1.0))})
    out = None
    for p in ("c", "v"):
        cells = (spread(g, *key).select(*key, E(f"lo_{p}").alias("lo"), ((E(f"hi_{p}") - E(f"lo_{p}")) / grid).alias("h"),
                          E(f"a_{p}").alias("a"), E(f"b_{p}").alias("b"),
                          F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
                 .withColumn("x", E("lo") + (E("i") + 0.5) * E("h"))
                 .withColumn("l", _log_kernel(E("x"), E("a"), E("b"))))
        w = Window.partitionBy(*key)
        cells = cells.withColumn("w", F.exp(E("l") - F.max("l").over(w)))
        cells = cells.withColumn("m", E("w") / F.sum("w").over(w))
        run = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("hi_cdf", F.sum("m").over(run)).withColumn("lo_cdf", E("hi_cdf") - E("m"))
        # equi-join key: the CDF bucket (1/grid wide); a cell spans the
        # buckets between its two CDF ends (at most a few for a smooth density)
        nb = grid
        cells = cells.withColumn("bucket", F.explode(F.sequence(
            F.floor(E("lo_cdf") * nb).cast("int"), F.least(F.floor(E("hi_cdf") * nb).cast("int"), F.lit(nb - 1)))))
        draws = (spread(g.select(*key), *key).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
                  .withColumn("u", fast_uniform(seed, E("day"), E("d"), p))
                  .withColumn("bucket", F.floor(E("u") * nb).cast("int")))
        hit = (draws.join(cells, [*key, "bucket"])
                    .filter((E("u") >= E("lo_cdf")) & (E("u") < E("hi_cdf")))
                    .select(*key, "d", (E("lo") + E("i") * E("h") + (E("u") - E("lo_cdf")) / E("m") * E("h")).alias(p)))
        out = hit if out is None else out.join(hit, [*key, "d"])
    return out.withColumn("lift", E("v") - E("c"))


def hdi(draws: DataFrame, value: str, key: list[str], alpha: float = 0.05, n_draws: int | None = None) -> DataFrame:
    """B-10: highest-density interval of draws per key: the narrowest window
    of floor((1 - alpha) n) steps among the sorted draws.  With ``n_draws``, the
    same for every key, the other end of a window is a ``lead``; else an
    equi-join on the position."""
    w = Window.partitionBy(*key).orderBy(value)
    if n_draws:
        d = draws.select(*key, E(value).alias("_lo"), F.lead(value, int((1.0 - alpha) * n_draws)).over(w).alias("_hi"),
                         F.row_number().over(w).alias("_r")).filter(E("_hi").isNotNull())
        best = d.groupBy(*key).agg(F.min_by(F.struct(E("_lo").alias("hdi_lower"), E("_hi").alias("hdi_upper")),
                                            F.struct((E("_hi") - E("_lo")).alias("w"), E("_r"))).alias("s"))
        return best.select(*key, "s.hdi_lower", "s.hdi_upper")
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    d = draws.select(*key, value).withColumns({"_r": F.row_number().over(w) - 1, "_n": n})
    d = d.withColumn("_inc", F.floor((1.0 - alpha) * E("_n")).cast("int"))
    # partner of row r is row r + inc: an equi-join on the position (no pairs)
    left = d.select(*key, "_r", "_inc", "_n", E(value).alias("_lo"))
    right = d.select(*key, E("_r").alias("_r2"), E(value).alias("_hi"))
    pos = left.withColumn("_rr", E("_r") + E("_inc")).filter(E("_rr") < E("_n"))
    j = pos.join(right.withColumnRenamed("_r2", "_rr"), [*key, "_rr"])
    # narrowest window; ties go to the lowest position (numpy argmin)
    best = j.groupBy(*key).agg(F.min_by(F.struct(E("_lo").alias("hdi_lower"), E("_hi").alias("hdi_upper")),
                                        F.struct((E("_hi") - E("_lo")).alias("w"), E("_r"))).alias("s"))
    return best.select(*key, "s.hdi_lower", "s.hdi_upper")
