"""Curves fitted again on bootstrap samples (X-5, X-6).

The replicate is one more grouping key: all replicates of all groups are fitted in
one plan, by the closed form of the curves that have one and by variable projection
(``projection``) of the others.  The driver holds no replicate and runs no loop over them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlytics.operators import curves as CV
from adlytics.operators import resample as R
from adlytics.operators.projection import SHAPES, projected_fit

E = F.col

FITS = {"linear": CV.linear_fit, "polynomial": CV.quadratic_fit, "logarithm": partial(CV.log_fit, c=1.0, d=5.0),
        **{c: partial(projected_fit, curve=c) for c in SHAPES}}


def bootstrap_pairs(df: DataFrame, group: str, order: str, x: str, y: str, trials: int,
                    paired: bool = True, seed: int = 11) -> DataFrame:
    """group, rep, x, y: ``trials`` samples with replacement of each group's rows,
    each as large as the group.  ``paired`` keeps x and y of a row together; else y is
    drawn on its own (with ``seed`` + 1), which breaks their relation: the refits then show
    what the curve gives if there is none.

    Rows of a group are numbered by ``order``, which must not repeat in it and holds
    a calendar's number of rows.  A NULL group gives no sample."""
    s = df.withColumn("idx", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)

    def draw(value, seed: int) -> DataFrame:
        return R.iid_bootstrap(s.select(E(group).alias("series"), "idx", value.alias("value")), trials, seed)

    if paired:
        both = draw(F.struct(E(x).alias("x"), E(y).alias("y")), seed)
        return both.select(E("series").alias(group), "rep", E("value.x").alias(x), E("value.y").alias(y))
    xs, ys = (draw(E(c), seed + k).select("series", "rep", "idx", E("value").alias(c)) for k, c in enumerate((x, y)))
    return xs.join(ys, ["series", "rep", "idx"]).select(E("series").alias(group), "rep", x, y)


def bootstrap_fit(df: DataFrame, group: str, order: str, x: str, y: str, curve: str, trials: int = 100,
                  paired: bool = True, seed: int = 11) -> DataFrame:
    """One row per (group, rep): the parameters of ``curve`` on that sample, and what
    else its fit returns."""
    return FITS[curve](bootstrap_pairs(df, group, order, x, y, trials, paired, seed), [group, "rep"], x, y)


def spread_of(fits: DataFrame, group: str, names: list[str], level: float = 0.95) -> DataFrame:
    """Per group: number of replicates, of those whose fit the data determine (all, if the fit has no
    status), and of these the mean, sd and the bounds that hold ``level`` of each parameter."""
    good = (E("status") == "converged") if "status" in fits.columns else F.lit(True)
    tails = [(1 - level) / 2, (1 + level) / 2]
    out = []
    for p in names:
        v = F.when(good, E(p))
        out += [F.avg(v).alias(f"mean_{p}"), F.stddev_samp(v).alias(f"sd_{p}"),
                F.percentile(v, tails[0]).alias(f"{p}_lower"), F.percentile(v, tails[1]).alias(f"{p}_upper")]
    return fits.groupBy(group).agg(F.count(F.lit(1)).alias("trials"), F.count_if(good).alias("fitted"), *out)
