"""Robust seasonal decomposition (T-1) as array columns.

A daily series is one row with an array of its values: its length is bounded by the
calendar, while the number of series (group x metric x cut-off x replicate) is
what grows and what Spark spreads.  All rounds run inside one row with
higher-order functions, so a decomposition needs a single shuffle (days to
arrays), no Python worker and no job per round.

A pass: take the trend off; smooth each cycle-subseries (the values of one phase) by
local lines and extend it by a period at both ends; take off the low-pass part of
that (moving averages of period, period and 3 days, then a local line); smooth what is
left of the series by local lines.  ``inner`` passes make a round; after each round
but the last, bisquare weights of the residuals (six times their median size) go into the next.

A local line at a place uses the ``window`` nearest days with tricube weights.
Where a window is wider than a few days it is computed at every ``jump``-th day and
drawn straight between (``jump`` 0: a tenth of the window, 1: every day).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = F.col


@dataclass(frozen=True)
class Seasons:
    """Period and windows of a decomposition; the unset windows follow from the
    period: trend the least odd number from 1.5 period / (1 - 1.5 / season) on,
    low-pass the least odd number above the period."""
    period: int = 365
    season: int = 13
    trend: int = 0
    low_pass: int = 0
    inner: int = 2
    outer: int = 15
    jump: int = 0

    def trend_window(self) -> int:
        least = -int(-(1.5 * self.period / (1 - 1.5 / self.season)) // 1)
        return self.trend or least + (least + 1) % 2

    def low_pass_window(self) -> int:
        return self.low_pass or self.period + 1 + self.period % 2

    def jump_of(self, window: int) -> int:
        return self.jump or -(-window // 10)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def days(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _line(y: Column, w: Column | None, first: Column, last: Column, x: Column, reach: Column, n: Column,
          at=lambda j: j) -> Column:
    """The tricube-weighted line through points first..last, at x.  ``at`` gives
    the array index of a point; without any weight the nearest value stands."""
    def weight(j):
        far = F.abs(j - x) / reach
        cube = 1 - far * far * far
        near = F.when(far <= 0.001, F.lit(1.0)).when(far <= 0.999, cube * cube * cube).otherwise(F.lit(0.0))
        return near if w is None else near * w[at(j)]

    def add(s, j):
        return let(F.struct(weight(j).alias("k"), (j - x).cast("double").alias("d"), y[at(j)].alias("v")), lambda p: F.struct(
            (s["s0"] + p["k"]).alias("s0"), (s["s1"] + p["k"] * p["d"]).alias("s1"), (s["s2"] + p["k"] * p["d"] * p["d"]).alias("s2"),
            (s["t0"] + p["k"] * p["v"]).alias("t0"), (s["t1"] + p["k"] * p["d"] * p["v"]).alias("t1")))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")])

    def value(s):
        spread = s["s2"] - s["s1"] * s["s1"] / s["s0"]
        slope = (s["t1"] - s["s1"] * s["t0"] / s["s0"]) / spread
        flat = s["t0"] / s["s0"]
        least = s["s0"] * (0.001 * (n - 1)) * (0.001 * (n - 1))
        return (F.when(s["s0"] <= 0, y[at(F.greatest(first, F.least(last, x)))])
                .when(spread > least, flat - slope * s["s1"] / s["s0"]).otherwise(flat))

    return let(F.aggregate(F.sequence(first, last), zero, add), value)


def _window(x: Column, n: Column, q: int) -> Column:
    """first, last, reach of the q points nearest to x among n."""
    first = F.greatest(F.least(x - (q - 1) // 2, n - q), F.lit(0))
    last = F.least(first + q, n) - 1
    more = F.when(n < q, F.floor((q - n) / 2).cast("int")).otherwise(0)
    reach = F.greatest(x - first, last - x) + more
    return F.struct(first.alias("first"), last.alias("last"), F.greatest(reach.cast("double"), F.lit(1e-9)).alias("reach"))


def local_lines(y: Column, w: Column | None, n: Column, q: int, jump: int) -> Column:
    """LOESS of an array: at every jump-th day and the last, straight between."""
    def at(x):
        return let(_window(x, n, q), lambda b: _line(y, w, b["first"], b["last"], x, b["reach"], n))

    if jump == 1:
        return F.transform(days(n), at)
    knots = F.transform(F.sequence(F.lit(0), F.ceil((n - 1) / jump).cast("int")), lambda k: at(F.least(k * jump, n - 1)))

    def between(k):
        def value(i):
            left = F.floor(i / jump).cast("int")
            share = (i - left * jump) / (F.least((left + 1) * jump, n - 1) - left * jump)
            return F.when(i % jump == 0, k[left]).otherwise(k[left] + (F.get(k, left + 1) - k[left]) * share)
        return F.transform(days(n), value)

    return let(knots, between)


def cycles(d: Column, w: Column, n: Column, period: int, q: int) -> Column:
    """The smoothed cycle-subseries, from a period before the first to a period after the last day."""
    def at(i):
        phase = F.pmod(i, F.lit(period))
        place = F.struct(phase.alias("k"), ((i - phase) / period).cast("int").alias("x"), (F.floor((n - 1 - phase) / period) + 1).cast("int").alias("m"))
        return let(place, lambda p: let(_window(p["x"], p["m"], q), lambda b: _line(
            d, w, b["first"], b["last"], p["x"], b["reach"], p["m"], lambda j: p["k"] + j * period)))

    return F.transform(F.sequence(F.lit(-period), n + period - 1), at)


CHUNK = 64


def running(x: Column) -> Column:
    """Sums of the first 0, 1, 2, ... values; by chunks, since a fold copies what it has."""
    def parts(x):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))
        return F.transform(chunks, lambda c: F.transform(
            F.sequence(F.lit(1), F.size(c)), lambda k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0.0), lambda a, v: a + v)))

    def joined(p):
        before = F.transform(p, lambda _, k: F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda a, c: a + F.element_at(c, -1)))
        return F.concat(F.array(F.lit(0.0)), F.flatten(F.zip_with(p, before, lambda c, b: F.transform(c, lambda v: v + b))))

    return let(let(x, parts), joined)


def moving_average(x: Column, width: int) -> Column:
    return let(running(x), lambda r: F.transform(F.sequence(F.lit(width), F.size(r) - 1), lambda i: (r[i] - r[i - width]) / width))


def one_pass(y: Column, n: Column, trend: Column, weight: Column, s: Seasons) -> Column:
    """Struct of trend and season after one inner pass."""
    low, wide = s.low_pass_window(), s.trend_window()

    def season(c):
        smooth = moving_average(moving_average(moving_average(c, s.period), s.period), 3)
        return let(let(smooth, lambda m: local_lines(m, None, n, low, s.jump_of(low))),
                   lambda m: F.zip_with(F.slice(c, F.lit(s.period + 1), n), m, lambda a, b: a - b))

    def rest(season):
        return let(F.zip_with(y, season, lambda a, b: a - b), lambda d: F.struct(
            local_lines(d, weight, n, wide, s.jump_of(wide)).alias("trend"), season.alias("season")))

    detrended = F.zip_with(y, trend, lambda a, b: a - b)
    return let(let(let(detrended, lambda d: cycles(d, weight, n, s.period, s.season)), season), rest)


def bisquare(y: Column, n: Column, trend: Column, season: Column) -> Column:
    """Weights of the residuals, 0 from six times their median size on."""
    size = F.transform(days(n), lambda i: F.abs(y[i] - trend[i] - season[i]))

    def weights(r):
        half = F.floor(n / 2).cast("int")
        middle = let(F.sort_array(r), lambda o: (o[half] + o[F.floor((n - 1) / 2).cast("int")]) / 2)
        return let(6 * middle, lambda h: F.transform(r, lambda v: F.when(v <= 0.001 * h, F.lit(1.0)).when(
            v <= 0.999 * h, (1 - (v / h) * (v / h)) * (1 - (v / h) * (v / h))).otherwise(F.lit(0.0))))

    return let(size, weights)


def decomposed(y: Column, s: Seasons) -> Column:
    """Struct of the arrays trend, season and weight of an array of days."""
    total = (s.outer + 1) * s.inner

    def parts(n):
        def step(state, k):
            def close(f):
                again = F.when((k % s.inner == 0) & (k < total), bisquare(y, n, f["trend"], f["season"])).otherwise(state["weight"])
                return F.struct(f["trend"].alias("trend"), f["season"].alias("season"), again.alias("weight"))
            return let(one_pass(y, n, state["trend"], state["weight"], s), close)

        zeros, ones = F.array_repeat(F.lit(0.0), n), F.array_repeat(F.lit(1.0), n)
        start = F.struct(zeros.alias("trend"), zeros.alias("season"), ones.alias("weight"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(total)), start, step)

    return let(F.size(y), parts)


def as_arrays(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ys: one row a series, its values in order of idx."""
    listed = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", E("value").cast("double").alias("value")))).alias("l"))
    return listed.select(*keys, E("l.value").alias("ys"))


def decompose_arrays(arrays: DataFrame, s: Seasons, tasks: int | None = None) -> DataFrame:
    """The arrays with trend, season, weight and residual; series of less than two
    periods are left out."""
    arrays = arrays.filter(F.size("ys") >= 2 * s.period)
    if tasks:
        arrays = arrays.repartition(tasks, *[c for c in arrays.columns if c != "ys"])
    out = arrays.withColumn("d", decomposed(E("ys"), s)).select(*arrays.columns, "d.trend", "d.season", "d.weight")
    return out.withColumn("residual", F.transform("ys", lambda v, i: v - E("trend")[i] - E("season")[i]))


def decompose(series: DataFrame, keys: list[str], s: Seasons = Seasons(), tasks: int | None = None) -> DataFrame:
    """T-1: keys, idx, value, trend, season, residual, weight of every day of
    ``series`` (keys, idx, value; idx counts the days of a gap-free series from 0)."""
    done = decompose_arrays(as_arrays(series, keys), s, tasks)
    rows = done.select(*keys, F.posexplode(F.arrays_zip("ys", "trend", "season", "residual", "weight")).alias("idx", "d"))
    return rows.select(*keys, "idx", E("d.ys").alias("value"), "d.trend", "d.season", "d.residual", "d.weight")
