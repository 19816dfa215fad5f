"""Window operators.

Running totals and rolling frames are evaluated on already-aggregated
(day-level) tables wherever the analysis allows, so a window partition never
holds raw events.  The one global ordering in the analyses (``lead`` over the
whole table, W-1) is split by day: :func:`global_lead` computes it without
sending every row to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, partition: list[str], order: str | Column, sums: dict[str, str]) -> DataFrame:
    """``sum(x) over (partition by p order by o)`` for every ``out: x`` pair
    (default frame: RANGE UNBOUNDED PRECEDING .. CURRENT ROW, as in SQL)."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumns({out: F.sum(src).over(w) for out, src in sums.items()})


def first_difference(df: DataFrame, order: str, cols: list[str], partition: list[str] | None = None,
                     suffix: str = "") -> DataFrame:
    """pandas ``diff()``: x - lag(x) for each column, NULL on the first row."""
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    return df.withColumns({f"{c}{suffix}": F.col(c) - F.lag(c, 1).over(w) for c in cols})


def shifted(df: DataFrame, order: str, col: str, lags: list[int], partition: list[str] | None = None) -> DataFrame:
    """pandas ``shift(k)`` for several k."""
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    return df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(w) for k in lags})


def global_lead(df: DataFrame, ts: str, out: str = "next", in_day_out: str | None = "next_intraday") -> DataFrame:
    """``lead(ts) over (order by ts)`` and ``lead(ts) over (partition by day order by ts)``.

    The global lead equals the in-day lead except on each day's last row,
    where it is the first timestamp of the next non-empty day.  That value
    comes from a day-level table (one row per day), so the only window over
    raw rows is partitioned by day; the day table is tiny for any input size.
    """
    day = F.to_date(F.col(ts))
    w_day = Window.partitionBy(day).orderBy(ts)
    base = df.withColumn("_day", day).withColumn("_lead_day", F.lead(ts).over(w_day))
    days = (df.groupBy(day.alias("_day")).agg(F.min(ts).alias("_first"))
              .withColumn("_next_first", F.lead("_first").over(Window.orderBy("_day")))
              .select("_day", "_next_first"))
    res = (base.join(days, "_day", "left")
               .withColumn(out, F.coalesce("_lead_day", "_next_first")))
    if in_day_out:
        res = res.withColumnRenamed("_lead_day", in_day_out)
    return res.drop("_day", "_next_first", "_lead_day")


def split_lag(df: DataFrame, keys: list[str], ts: str, value: str, out: str,
              direction: int = -1, tie: list[str] | None = None) -> DataFrame:
    """``lag(value, 1)`` (direction -1) or ``lead(value, 1)`` (+1) over
    ``partition by keys order by ts`` without a whole-key window partition.
    Columns ``tie`` order rows of one timestamp.

    Rows are windowed inside (keys, day) partitions; a day's first row (last
    row for lead) takes its value from the neighbouring non-empty day of the
    same key, read from a table with one row per (key, day).  Exact for any
    key skew: a key holding a third of all rows is spread over its days.
    """
    day = "_split_day"
    base = df.withColumn(day, F.to_date(F.col(ts)))
    order = [ts, *(tie or [])]
    w_in = Window.partitionBy(*keys, day).orderBy(*order)
    shift = F.lag(value, 1) if direction < 0 else F.lead(value, 1)
    base = base.withColumn("_in", shift.over(w_in))
    edge_fn = F.max_by if direction < 0 else F.min_by
    edges = (base.groupBy(*keys, day).agg(edge_fn(value, F.struct(*order)).alias("_edge")))
    w_days = Window.partitionBy(*keys).orderBy(day)
    edge_shift = F.lag("_edge", 1) if direction < 0 else F.lead("_edge", 1)
    edges = (edges.withColumn("_nb", edge_shift.over(w_days))
                  .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          F.col(day).alias("_eday"), "_nb"))
    # first (last) row of each day: take the neighbouring day's edge value.
    # Keys may be NULL, so the join is null-safe.
    pos = F.row_number().over(Window.partitionBy(*keys, day).orderBy(
        *[F.col(c).asc() if direction < 0 else F.col(c).desc() for c in order]))
    base = base.withColumn("_pos", pos)
    cond = base[day] == edges["_eday"]
    for i, k in enumerate(keys):
        cond = cond & base[k].eqNullSafe(edges[f"_k{i}"])
    res = (base.join(edges, cond, "left")
               .withColumn(out, F.when(F.col("_pos") == 1, F.col("_nb")).otherwise(F.col("_in"))))
    return res.drop(day, "_eday", "_in", "_nb", "_pos", *[f"_k{i}" for i in range(len(keys))])


def rolling_prev_rows(df: DataFrame, keys: list[str], ts: str, value: str, n: int,
                      outputs: dict[str, str], tie: list[str] | None = None, alone: bool = True) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN n PRECEDING AND 1 PRECEDING`` of
    ``partition by keys order by ts`` without a whole-key window partition.

    ``outputs`` maps output column -> aggregate name ('avg', 'stddev').  Columns
    ``tie`` order rows of one timestamp.  ``alone=False`` leaves out keys
    that have a single row.

    Rows are windowed inside (keys, day) partitions.  From its n+1st row on, a
    day needs nothing else.  Its first n rows are windowed once more behind the
    carry-over, the last n rows of the key before that day.  The carry is
    found without pairing days: the last n rows of every (key, day) form a
    tail table (at most n rows per key-day), numbered in time order per key;
    day c needs tail positions P_c - n .. P_c - 1, where P_c counts the tail
    rows of earlier days; those n positions are exploded per day and
    equi-joined on (key, position).  Exact for any skew; the extra rows are
    at most n per (key, day).

    Body, first rows and tail start from one exchange of the input, if they
    read the same columns: so name further columns of ``df`` in ``tie``."""
    day, order = "_rday", [ts, *(tie or [])]
    fns = {"avg": F.avg, "stddev": F.stddev_samp}
    whole = Window.partitionBy(*keys, day)
    in_day = whole.orderBy(*order)
    # a running count, since a limit on row_number() would be an exchange of its own
    nth = F.count(F.lit(1)).over(in_day.rowsBetween(Window.unboundedPreceding, 0))
    base = (df.withColumn(day, F.to_date(F.col(ts)))
              .withColumns({"_nth": nth, "_left": F.count(F.lit(1)).over(whole) - nth}))
    body = (base.withColumns({o: fns[a](value).over(in_day.rowsBetween(-n, -1)) for o, a in outputs.items()})
            .filter(F.col("_nth") > n).drop("_nth", "_left"))
    heads = base.filter(F.col("_nth") <= n).drop("_nth", "_left").withColumn("_carry", F.lit(0))
    tail = base.filter(F.col("_left") < n).select(*keys, day, *order, value)
    w_key = Window.partitionBy(*keys).orderBy(day, *order)
    tail = tail.withColumn("_pos", F.row_number().over(w_key) - 1)       # ≤ n rows per key-day
    # the number of rows, put so that value is read: without it the exchange could not be used again
    days = tail.groupBy(*keys, day).agg(F.greatest(F.count(F.lit(1)), F.count(value)).alias("_m"))
    by_day = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"_P": F.coalesce(F.sum("_m").over(by_day), F.lit(0)),
                             "_all": F.sum("_m").over(Window.partitionBy(*keys))})
    need = (days.filter(F.col("_P") > 0)
                .withColumn("_pos", F.explode(F.sequence(F.greatest(F.col("_P") - n, F.lit(0)), F.col("_P") - 1)))
                .select(*keys, F.col(day).alias("_target"), "_pos"))

    def same_keys(a: DataFrame, b: DataFrame) -> Column:
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & a[k].eqNullSafe(b[f"_t{i}"])          # a NULL key is one partition too
        return cond

    other = [F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]
    t2 = tail.select(*other, F.col("_pos").alias("_tpos"), *order, value)
    carry = (need.join(t2, (need["_pos"] == t2["_tpos"]) & same_keys(need, t2))
                 .select(*keys, F.col("_target").alias(day), *order, value)
                 .withColumn("_carry", F.lit(1)))
    if not alone:
        single = days.filter(F.col("_all") == 1).select(*other, F.col(day).alias("_sday"))
        heads = heads.join(single, heads[day].eqNullSafe(single["_sday"]) & same_keys(heads, single), "left_anti")
    start = Window.partitionBy(*keys, day).orderBy(F.desc("_carry"), *order).rowsBetween(-n, -1)
    heads = (heads.unionByName(carry, allowMissingColumns=True)
             .withColumns({o: fns[a](value).over(start) for o, a in outputs.items()})
             .filter(F.col("_carry") == 0).drop("_carry"))
    return body.unionByName(heads).drop(day)
