"""Damped additive Holt-Winters (T-3), forecast horizons (T-4) and bands (T-6).

A series is one row with an array of values.  The recursion is an ordered fold of
the state (level, slope, ring of the last ``period`` season terms, squared error) as
a column ``aggregate``; parameter candidates are rows, so each (series, replicate,
candidate) is a key of its own, and the best one is a ``min_by``.

Start: level and slope from the means of the first two periods, season terms from the
first period.  Step, with e the slope damped by phi:

    l' = alpha (y - s) + (1 - alpha) (l + e)
    b' = beta (l' - l) + (1 - beta) e
    s' = gamma (y - l - e) + (1 - gamma) s

The forecast h days ahead is l + (phi + ... + phi^h) b + s of that day's phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.operators.bayes import spread
from adlytics.operators.seasonal import let

E = F.col

# alpha, beta, gamma, phi; candidates with beta > alpha or gamma > 1 - alpha are left out
GRID = ((0.05, 0.2, 0.5), (0.01, 0.1), (0.05, 0.2, 0.5), (0.9, 0.98))


def candidates(grid=GRID) -> list[tuple[float, float, float, float]]:
    alphas, betas, gammas, phis = grid
    return [(a, b, c, p) for a in alphas for b in betas for c in gammas for p in phis if b <= a and c <= 1 - a]


def _mean(x: Column, first, count: int) -> Column:
    return F.aggregate(F.slice(x, first, count), F.lit(0.0), lambda a, v: a + v) / count


def folded(y: Column, p: Column, period: int) -> Column:
    """Struct of level, slope, ring and sse after all values."""
    def start(means):
        slope = (means["b"] - means["a"]) / period
        middle = (period - 1) / 2
        ring = F.transform(F.slice(y, 1, period), lambda v, i: v - means["a"] - slope * (i - middle))
        return F.struct((means["a"] + slope * middle).alias("level"), slope.alias("slope"), ring.alias("ring"), F.lit(0.0).alias("sse"))

    def step(s, v):
        def close(x):
            level = p["alpha"] * (v - x["s"]) + (1 - p["alpha"]) * (s["level"] + x["e"])
            return let(level, lambda n: F.struct(
                n.alias("level"), (p["beta"] * (n - s["level"]) + (1 - p["beta"]) * x["e"]).alias("slope"),
                F.concat(F.slice(s["ring"], 2, period - 1), F.array(p["gamma"] * (v - s["level"] - x["e"]) + (1 - p["gamma"]) * x["s"])).alias("ring"),
                (s["sse"] + (v - s["level"] - x["e"] - x["s"]) * (v - s["level"] - x["e"] - x["s"])).alias("sse")))
        return let(F.struct((p["phi"] * s["slope"]).alias("e"), s["ring"][0].alias("s")), close)

    means = F.struct(_mean(y, 1, period).alias("a"), _mean(y, period + 1, period).alias("b"))
    return let(means, lambda m: F.aggregate(F.slice(y, F.lit(period + 1), F.size(y) - period), start(m), step))


def holt_winters(arrays: DataFrame, keys: list[str], period: int, grid=GRID) -> DataFrame:
    """T-3: keys, alpha, beta, gamma, phi, sse, level, slope, ring of the best
    candidate of each row of ``arrays`` (keys, ys); rows of less than two periods are left out."""
    fields = ("alpha", "beta", "gamma", "phi")
    listed = F.array(*[F.struct(F.lit(i).alias("no"), *[F.lit(v).alias(f) for f, v in zip(fields, c)]) for i, c in enumerate(candidates(grid))])
    rows = arrays.filter(F.size("ys") >= 2 * period).withColumn("p", F.explode(listed))
    rows = spread(rows.withColumn("_no", E("p.no")), *keys, "_no")
    rows = rows.withColumn("fit", folded(E("ys"), E("p"), period))
    best = rows.select(*keys, "p", "fit").groupBy(*keys).agg(F.min_by(F.struct("p", "fit"), F.struct("fit.sse", "p.no")).alias("best"))
    return best.select(*keys, *[E(f"best.p.{f}").alias(f) for f in fields], *[E(f"best.fit.{f}").alias(f) for f in ("sse", "level", "slope", "ring")])


def horizon(last: Column, mode: str = "cutoff") -> Column:
    """T-4: struct of the first and last day to predict.  ``cutoff``: from the last
    day of the data to its month's end; ``month_start``: the whole of that month.  The
    model is trained on the days before the first."""
    first = last if mode == "cutoff" else F.trunc(last, "month").cast("date")
    return F.struct(first.alias("first"), F.last_day(last).alias("last"))


def predicted(fits: DataFrame, keys: list[str], first: str, last: str, period: int) -> DataFrame:
    """keys, date, prediction for every day from ``first`` to ``last`` (columns)."""
    rows = fits.withColumn("date", F.explode(F.sequence(E(first), E(last)))).withColumn("h", F.datediff("date", E(first)) + 1)
    damped = E("phi") * (1 - F.pow("phi", E("h"))) / (1 - E("phi"))
    return rows.select(*keys, "date", (E("level") + damped * E("slope") + E("ring")[F.pmod(E("h") - 1, F.lit(period))]).alias("prediction"))


def band(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """T-6 / A-16: mean, and mean -+ sample standard deviation, across replicates."""
    g = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.select(*keys, "mean", (E("mean") - E("sd")).alias("lower"), (E("mean") + E("sd")).alias("upper"))
