"""Column helpers that pin down the semantic rules the analyses depend on.

Each helper returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_boundaries(start: str | Column, end: str | Column) -> Column:
    """Number of hour boundaries crossed from ``start`` to ``end``.

    Warehouse ``datediff('hour', a, b)`` counts boundaries (00:50 -> 01:10 is 1),
    Spark's ``timestampdiff`` counts elapsed hours; truncating both ends first
    makes the two agree.
    """
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", col(start)), F.date_trunc("HOUR", col(end)))


def day_of(c: str | Column) -> Column:
    """``date_trunc('day', ts)`` as a DATE."""
    return F.to_date(col(c))


def week_of(c: str | Column) -> Column:
    """Monday-based week start as a DATE."""
    return F.to_date(F.date_trunc("WEEK", col(c)))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(col(num), col(den))


def half_even(c: str | Column, scale: int = 0) -> Column:
    """numpy / pandas ``round``: banker's rounding."""
    return F.bround(col(c), scale)


def full_match(c: str | Column, pattern: str) -> Column:
    """Warehouse ``regexp_like``: the pattern must match the whole string."""
    return col(c).rlike(f"^(?:{pattern})$")


def nvl(*cols) -> Column:
    return F.coalesce(*[col(c) if isinstance(c, (str, Column)) else F.lit(c) for c in cols])


def asc_last(c: str | Column) -> Column:
    """Ascending with NULLs last, the warehouse / DuckDB default."""
    return col(c).asc_nulls_last()


def bounded_bucket(c: str | Column, lo: float | Column, hi: float | Column, n: int) -> Column:
    """Equal-width histogram bin 1..n; the maximum goes into bin n (numpy)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    # width_bucket written out so that the arithmetic is the same in every engine
    return F.least(F.floor((col(c) - lo_c) / (hi_c - lo_c) * F.lit(n)) + 1, F.lit(n))
