"""Reshaping operators: calendar spines, pivots, melts, trial expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_spine(bounds: DataFrame, lo: str, hi: str, out: str = "date", step: str = "1 day") -> DataFrame:
    """One row per day from ``lo`` to ``hi`` of each row of ``bounds``
    (``explode(sequence(...))``); other columns of ``bounds`` are kept, so a
    bounds table keyed by series gives one calendar per series."""
    keep = [c for c in bounds.columns if c not in (lo, hi)]
    return bounds.select(*keep, F.explode(F.sequence(F.to_date(F.col(lo)), F.to_date(F.col(hi)),
                                                      F.expr(f"interval {step}"))).alias(out))


def fill_calendar(df: DataFrame, keys: list[str], date_col: str, values: list[str]) -> DataFrame:
    """pandas ``resample('1D').sum()``: per key, every day between the key's
    first and last date, missing values 0."""
    b = df.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    spine = date_spine(b, "_lo", "_hi", date_col)
    j = spine.join(df, [*keys, date_col], "left")
    return j.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def pivot_values(df: DataFrame, group: list[str], pivot_col: str, values: list, agg: str, value_col: str,
                 names: list[str] | None = None) -> DataFrame:
    """Pivot with a fixed list of values: one conditional aggregate per value
    (no extra pass to discover the values; empty cells follow the aggregate:
    count -> 0, sum/first -> NULL)."""
    fn = {"count": F.count, "sum": F.sum, "first": lambda c: F.first(c, ignorenulls=True),
          "max": F.max, "min": F.min, "avg": F.avg}[agg]
    names = names or [str(v) for v in values]
    return df.groupBy(*group).agg(*[fn(F.when(F.col(pivot_col) == F.lit(v), F.col(value_col))).alias(n)
                                    for v, n in zip(values, names)])


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "variable", val: str = "value",
         dropna: bool = True) -> DataFrame:
    """Wide to long (``unpivot``), optionally dropping NULL values."""
    out = df.unpivot(ids, values, var, val)
    return out.filter(F.col(val).isNotNull()) if dropna else out


def expand_trials(df: DataFrame, n: str | Column, k: str | Column, out: str = "trial") -> DataFrame:
    """Expand counts to 0/1 trials: n-k zeros then k ones per row.  Only
    used where individual trials are needed; sums and lengths of the trials
    are just k and n."""
    n_c = F.col(n) if isinstance(n, str) else n
    k_c = F.col(k) if isinstance(k, str) else k
    arr = F.concat(F.array_repeat(F.lit(0), (n_c - k_c).cast("int")), F.array_repeat(F.lit(1), k_c.cast("int")))
    return df.withColumn(out, F.explode(arr))
