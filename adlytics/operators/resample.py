"""Resampling with hash draws (X-1 .. X-8).

Series are long tables ``(series, idx, value)`` with idx = 0..n-1 in time
order; replicates are rows ``(series, rep, idx, value)``, never columns.
Every draw is ``hash(seed, series, rep, i)`` (see ``functions.draws``), so a
replicate does not depend on partitioning or on which executor ran it, and
a lost task recomputes exactly the same rows.

The replicate table grows as series x reps x n; it is built by exploding a
small (series, rep) table and fetching values with an equi join on
(series, idx), both shuffled by series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.functions.draws import TWO_32, hash_int
from adlytics.operators.bayes import spread

E = F.col


def series_lengths(series: DataFrame, key: str = "series") -> DataFrame:
    return series.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _fetch(draws: DataFrame, series: DataFrame, key: str) -> DataFrame:
    vals = series.select(key, E("idx").alias("src"), "value")
    return draws.join(vals, [key, "src"]).select(key, "rep", "idx", "src", "value")


def iid_bootstrap(series: DataFrame, reps: int, seed: int = 42, key: str = "series") -> DataFrame:
    """X-1/X-5: n draws with replacement per replicate."""
    n = series_lengths(series, key)
    d = (spread(n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), key, "rep")
          .withColumn("idx", F.explode(F.sequence(F.lit(0), E("n").cast("int") - 1)))
          .withColumn("src", F.pmod(hash_int(seed, E(key), E("rep"), E("idx")), E("n"))))
    return _fetch(d, series, key)


def block_size(n) -> F.Column:
    """X-3: floor(n ** (1/5))."""
    return F.floor(F.pow(n.cast("double"), F.lit(0.2))).cast("int")


def circular_block_bootstrap(series: DataFrame, reps: int, seed: int = 42, key: str = "series",
                             size: int | None = None) -> DataFrame:
    """X-2: ceil(n / b) random block starts per replicate, b consecutive
    indices from each start (wrapping modulo n), cut to n values."""
    n = series_lengths(series, key)
    n = n.withColumn("b", F.lit(size) if size else block_size(E("n")))
    n = n.withColumn("nb", F.ceil(E("n") / E("b")).cast("int"))
    d = (spread(n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), key, "rep")
          .withColumn("blk", F.explode(F.sequence(F.lit(0), E("nb") - 1)))
          .withColumn("start", F.pmod(hash_int(seed, E(key), E("rep"), E("blk")), E("n")))
          .withColumn("off", F.explode(F.sequence(F.lit(0), E("b") - 1)))
          .withColumn("idx", E("blk") * E("b") + E("off"))
          .filter(E("idx") < E("n"))
          .withColumn("src", F.pmod(E("start") + E("off"), E("n"))))
    return _fetch(d, series, key)


def stationary_bootstrap(series: DataFrame, reps: int, mean_length: float, seed: int = 42, key: str = "series") -> DataFrame:
    """X-7: blocks of geometric length.  Every place starts a new block with probability
    1 / mean_length (the first one always) at a drawn day; else it takes the
    day after its neighbour's, wrapping modulo n.  The start of a place's block is
    a running maximum within (series, replicate), whose length the calendar bounds."""
    from pyspark.sql import Window
    n = series_lengths(series, key)
    d = spread(n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), key, "rep")
    d = d.withColumn("idx", F.explode(F.sequence(F.lit(0), E("n").cast("int") - 1)))
    fresh = (E("idx") == 0) | (hash_int(seed, E(key), E("rep"), E("idx"), "cut") * mean_length < TWO_32)
    w = Window.partitionBy(key, "rep").orderBy("idx")
    d = d.withColumn("_at", F.max(F.when(fresh, E("idx"))).over(w))
    start = hash_int(seed, E(key), E("rep"), E("_at"), "start")
    return _fetch(d.withColumn("src", F.pmod(start + E("idx") - E("_at"), E("n"))), series, key)


def holdout_split(df: DataFrame, key: list[str], row_id: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """X-8: per key, the ceil(share * n) rows with the smallest hash of
    (seed, row id) form the test set.  The ranking window is partitioned
    by key over a day-level table (bounded by the number of days)."""
    from pyspark.sql import Window
    h = hash_int(seed, *[E(k) for k in key], E(row_id))
    w = Window.partitionBy(*key).orderBy(h, E(row_id))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return (df.withColumns({"_r": F.row_number().over(w), "_n": n})
              .withColumn("is_test", E("_r") <= F.ceil(E("_n") * share))
              .drop("_r", "_n"))


def replicate_arrays(parts: DataFrame, keys: list[str], reps: int, seed: int = 42, blocks: bool = True) -> DataFrame:
    """X-4: residual bootstrap of decomposed series, one row (keys, rep, ys) a replicate.
    ``parts`` has keys and the arrays trend, season, residual; trend and season
    stay at their day (J-9), residuals are drawn by X-2 (``blocks``) or X-1.  Nothing is joined or
    shuffled but the (keys, rep) rows.  Replicates that are all negative go (P-19)."""
    rows = spread(parts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), *keys, "rep")
    n = F.size("residual")
    rows = rows.withColumns({"n": n, "b": block_size(n) if blocks else F.lit(1)})

    def day(t, i):
        block = F.floor(i / E("b")).cast("int")
        start = F.pmod(hash_int(seed, *[E(k) for k in keys], E("rep"), block), E("n"))
        return t + E("season")[i] + E("residual")[F.pmod(start + i % E("b"), E("n")).cast("int")]

    rows = rows.withColumn("ys", F.transform("trend", day)).select(*keys, "rep", "ys")
    return rows.filter(F.exists("ys", lambda v: v >= 0))
