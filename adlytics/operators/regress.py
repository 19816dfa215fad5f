"""Regression tests and GLMs (M-1 .. M-4).

* Chow break test: three straight-line fits of y on the row index (pooled,
  before, after) from sufficient statistics; every split point is handled
  in ONE aggregate (rows carry an array of split points and are exploded,
  so a row meets each split once; no join of rows with rows).
* GLMs: ``pyspark.ml`` GeneralizedLinearRegression (IRLS on the cluster);
  the summary table has coefficient, standard error, t/z value and p-value.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = F.col


def chow_test(df: DataFrame, x: str, y: str, splits: list[tuple[int, int]], k: int = 2) -> DataFrame:
    """F statistic of a structural break between rows with x <= last and
    rows with x >= first, for each (last, first) split."""
    arr = F.array(*[F.struct(F.lit(a).alias("last_index"), F.lit(b).alias("first_index")) for a, b in splits])
    d = df.select(E(x).cast("double").alias("x"), E(y).cast("double").alias("y"), F.explode(arr).alias("s"))
    d = d.select("x", "y", "s.last_index", "s.first_index")
    parts = {"p": F.lit(True), "1": E("x") <= E("last_index"), "2": E("x") >= E("first_index")}
    aggs = []
    for nm, cond in parts.items():
        c = lambda v: F.sum(F.when(cond, v).otherwise(0.0))
        aggs += [F.count(F.when(cond, 1)).alias(f"n{nm}"), c(E("x")).alias(f"sx{nm}"), c(E("y")).alias(f"sy{nm}"),
                 c(E("x") * E("x")).alias(f"sxx{nm}"), c(E("x") * E("y")).alias(f"sxy{nm}"),
                 c(E("y") * E("y")).alias(f"syy{nm}")]
    s = d.groupBy("last_index", "first_index").agg(*aggs)
    for nm in parts:
        n = E(f"n{nm}")
        sxx = E(f"sxx{nm}") - E(f"sx{nm}") * E(f"sx{nm}") / n
        sxy = E(f"sxy{nm}") - E(f"sx{nm}") * E(f"sy{nm}") / n
        syy = E(f"syy{nm}") - E(f"sy{nm}") * E(f"sy{nm}") / n
        s = s.withColumn(f"rss_{nm}", syy - sxy * sxy / sxx)
    df1 = F.lit(float(k))
    df2 = (E("n1") + E("n2") - 2 * k).cast("double")
    num = (E("rss_p") - (E("rss_1") + E("rss_2"))) / df1
    den = (E("rss_1") + E("rss_2")) / df2
    return s.select("last_index", "first_index", E("n1").alias("n_before"), E("n2").alias("n_after"),
                    E("rss_p").alias("rss_pooled"), E("rss_1").alias("rss_before"), E("rss_2").alias("rss_after"),
                    F.when(den > 0, num / den).alias("f_stat"), df1.alias("df1"), df2.alias("df2"))


def chow_significance(chow: DataFrame, significance: float = 0.05) -> DataFrame:
    """Upper-tail p-value of the break test.  With two parameters a line the
    numerator has two degrees of freedom, and P(F > f) has the closed form
    (1 + 2 f / df2) ^ (-df2 / 2); other numerators give NULL."""
    closed = F.pow(1 + 2 * E("f_stat") / E("df2"), -E("df2") / 2)
    return (chow.withColumn("p_value", F.when(E("df1") == 2, closed))
                .withColumn("reject_no_break", E("p_value") < significance))


# ---------------------------------------------------------------------- GLMs
def glm(df: DataFrame, y: str, xs: list[str], family: str = "gaussian", link: str | None = None,
        max_iter: int = 50) -> DataFrame:
    """Fit a GLM with intercept; one row per term (const first) with
    coefficient, standard error, t/z value, p-value, plus model deviance,
    dispersion and AIC on every row."""
    d = df.select(*[E(c).cast("double").alias(c) for c in [y, *xs]]).na.drop()
    va = VectorAssembler(inputCols=xs, outputCol="_features")
    kw = dict(family=family, featuresCol="_features", labelCol=y, maxIter=max_iter, fitIntercept=True)
    if link:
        kw["link"] = link
    # IRLS and the summary statistics are several passes over the design:
    # keep it (one row per period) instead of recomputing its lineage each pass
    x = va.transform(d).select("_features", y).persist()
    model = GeneralizedLinearRegression(**kw).fit(x)
    s = model.summary
    coefs = [float(model.intercept)] + [float(c) for c in model.coefficients]
    names = ["const", *xs]
    try:
        se = list(s.coefficientStandardErrors)
        tv = list(s.tValues)
        pv = list(s.pValues)
        # summary lists the intercept last
        se, tv, pv = [se[-1]] + se[:-1], [tv[-1]] + tv[:-1], [pv[-1]] + pv[:-1]
    except (PySparkException, Py4JJavaError) as err:
        if "singular" not in str(err).lower():
            raise
        se = tv = pv = [None] * len(names)
    rows = [(n, c, e, t, p, float(s.deviance), float(s.dispersion), float(s.aic), int(s.numInstances))
            for n, c, e, t, p in zip(names, coefs, se, tv, pv)]
    x.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, t_value double, p_value double, "
              "deviance double, dispersion double, aic double, n bigint")


def lagged(df: DataFrame, order: str, col: str, lags: list[int]) -> DataFrame:
    """M-3: lagged copies of a column (on a period-level table)."""
    from pyspark.sql import Window
    w = Window.orderBy(order)
    return df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(w) for k in lags})


def with_index(df: DataFrame, order: str, out: str = "idx") -> DataFrame:
    """Row position after ordering a period-level table (the pandas index)."""
    from pyspark.sql import Window
    return df.withColumn(out, F.row_number().over(Window.orderBy(order)) - 1)


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))
