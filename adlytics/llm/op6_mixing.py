"""Mixing sources to target weights, in DataFrame functions only.

1. Words per source (one aggregate; map-side combine, one row per source).
2. Targets: a budget of 150 % of all words is shared by weight; a source's
   target stops at ``cap`` times its words and the excess is shared again by
   weight until none is above.  That fixed point is a water level: with the
   sources ordered by cap/weight, the first so many are at their cap and the
   rest get weight * level.
3. rate = target / words of the source.  Each document is taken floor(rate)
   times plus once more if its hash draw is below the fraction.

Per-source rows go through one window: there are as many as sources, never as
documents.  The rates return to the documents by a broadcast if there are at
most MAX_BROADCAST sources, else by a join that AQE splits when a source is hot.

Null texts have size 0, a null source is a source (weighed last).  A draw is of
doc_id and text, so documents without an id, or that share one, draw each for
itself; only rows equal in both share a draw (a null counts as the text 'null').  Sources
without words have target 0.  Input columns named like an output column are
replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.llm.common import WORD, checkpoint, load

WEIGHTS = (3, 1, 2)
BUDGET = Fraction(3, 2)
CAP = 2
SEED = "mix-1"
MAX_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of an md5, the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("full", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    num, den = budget.numerator, budget.denominator
    per = (per.withColumn("room", F.lit(num) * total - F.lit(den) * F.coalesce(F.sum("full").over(before), F.lit(0)))
              .withColumn("share", F.sum("weight").over(rest)))
    # the level if this source and all after it were below their caps
    level = F.col("room") / (F.lit(den) * F.col("share"))
    fits = F.col("room") * F.col("weight") <= F.lit(den) * F.col("share") * F.col("full")
    per = per.withColumn("level", F.first(F.when(fits, level), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("weight") * F.col("level"), F.col("full").cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.col("full").cast("double")).alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes it)."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", n_words(F.col("text")))
    targets = checkpoint(source_targets(sized.select("source", "size"), weights, budget, cap))
    if targets.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        targets = F.broadcast(targets)
    targets = targets.withColumnRenamed("source", "_source")
    out = sized.join(targets, sized["source"].eqNullSafe(targets["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("long")
    return out.withColumn("copies", F.least(whole + extra, F.lit(cap).cast("long")))


def emit_mix(planned: DataFrame) -> DataFrame:
    """Each document as often as the plan says, with its copy number from 0."""
    return (planned.filter(F.col("copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle(docs: str = "documents") -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(text), 'null') AS of_text
  FROM {docs}),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         sum(source_size) OVER () AS total
  FROM per),
-- the level at which the targets use up the budget: try each source as the first one below its cap
tries AS (
  SELECT a.source,
         CAST(3 * a.total - 2 * (SELECT coalesce(sum(2 * b.source_size), 0) FROM weighed b
                                 WHERE 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w) AS DOUBLE)
         / CAST(2 * (SELECT sum(b.w) FROM weighed b WHERE 2.0 * b.source_size / b.w >= 2.0 * a.source_size / a.w) AS DOUBLE) AS level,
         2.0 * a.source_size / a.w AS lim
  FROM weighed a),
chosen AS (SELECT level FROM tries WHERE level <= lim * (1 + 1e-15) ORDER BY lim LIMIT 1),
targets AS (
  SELECT source, source_size,
         coalesce(least(w * (SELECT level FROM chosen), CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target
  FROM weighed),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.of_text), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 2) AS BIGINT) * size AS taken
FROM rated
""".replace("\\\\", "\\")


ORACLE = oracle()
