"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_runs(df: DataFrame, keys: list[str], value: str, small: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """Each value of a group with its count: _k (struct of keys), _v, _c, _s (salt); and the
    groups of more than ``small`` values, once for each salt."""
    runs = (df.filter(F.col(value).isNotNull())
            .groupBy(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(salts))))
    large = runs.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > small)
    return runs, large.select("_k", _salts(salts))


def _salts(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_s")


def in_ranges(runs: DataFrame, bins: int, salts: int) -> DataFrame:
    """The runs with ``_bin``, the number of the value range they lie in.  Approximate
    quantiles of the runs cut a group, so ranges hold about equally many values."""
    shares = [i / bins for i in range(1, bins)]
    cuts = (runs.groupBy("_k").agg(F.percentile_approx("_v", shares, 10 * bins).alias("_cuts"))
            .select("_k", F.array_distinct("_cuts").alias("_cuts"), _salts(salts)))
    below = F.size(F.filter("_cuts", lambda x: x < F.col("_v")))
    return runs.join(cuts, ["_k", "_s"]).select("_k", below.alias("_bin"), "_v", "_c")


def quantile_of_ranges(tagged: DataFrame, q: float) -> DataFrame:
    """_k, _q from runs in ranges: exact counts per range, summed up, tell which range holds
    the wanted rank (two, if the ranks around the quantile fall on both sides of a cut); only its
    runs are sorted and counted on."""
    group = Window.partitionBy("_k")
    before = Window.unboundedPreceding, -1
    place = (F.sum("_c").over(group) - 1) * F.lit(float(q))
    ranges = (tagged.groupBy("_k", "_bin").agg(F.sum("_c").alias("_c"))
              .select("_k", "_bin", F.coalesce(F.sum("_c").over(group.orderBy("_bin").rowsBetween(*before)), F.lit(0)).alias("_first"),
                      F.col("_c").alias("_n"), F.floor(place).alias("_lo"), F.ceil(place).alias("_hi"), place.alias("_at")))

    def holds(rank: str, first: Column, count: Column) -> Column:
        return (F.col(rank) >= first) & (F.col(rank) < first + count)

    wanted = ranges.filter(holds("_lo", F.col("_first"), F.col("_n")) | holds("_hi", F.col("_first"), F.col("_n")))
    inside = Window.partitionBy("_k", "_bin").orderBy("_v").rowsBetween(*before)
    found = (tagged.join(wanted, ["_k", "_bin"])
             .withColumn("_first", F.col("_first") + F.coalesce(F.sum("_c").over(inside), F.lit(0))))
    lower, upper = (F.max(F.when(holds(r, F.col("_first"), F.col("_c")), F.col("_v"))) for r in ("_lo", "_hi"))
    ends = found.groupBy("_k").agg(lower.alias("_a"), upper.alias("_b"), F.max(F.col("_at") - F.col("_lo")).alias("_f"))
    between = F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f")
    return ends.select("_k", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("_q"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "quantile",
                   bins: int = 256, small: int = 4096, salts: int = 64) -> DataFrame:
    """keys and the exact ``q`` quantile of ``value`` (linear between neighbours,
    as ``median``), without a buffer that holds a group.

    Equal values become one run (value, count).  Groups of at most ``small`` runs go to
    the built-in ``percentile``, whose buffer that bounds.  A larger group is cut into
    ``bins`` value ranges: about 1/``bins`` of its distinct values are in one window
    partition, and its runs are joined under ``salts`` keys, so a group that holds
    nearly all rows is many tasks everywhere.  Both ways give the same result.

    NULL values count nowhere, a group without others gives no row; NaN is the
    largest value.  A NULL key is a group."""
    runs, large = value_runs(df, keys, value, small, salts)
    least = (runs.join(large.withColumn("_large", F.lit(True)), ["_k", "_s"], "left").filter(F.col("_large").isNull())
             .groupBy("_k").agg(F.percentile("_v", F.lit(float(q)), F.col("_c")).alias("_q")))
    most = quantile_of_ranges(in_ranges(runs.join(large, ["_k", "_s"], "left_semi"), bins, salts), q)
    return least.unionByName(most).select("_k.*", F.col("_q").alias(out))
