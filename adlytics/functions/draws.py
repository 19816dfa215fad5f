"""Hash-based uniform draws.

A draw is a pure function of ``(seed, key...)``: the first 8 hex digits of
``md5(concat_ws('-', seed, key...))`` read as an unsigned 32-bit integer and
divided by 2**32.  The same value is computed by DuckDB with
``('0x' || substr(md5(...), 1, 8))::BIGINT``, so every resampling step is
repeatable under any partitioning and checkable against the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, *parts) -> Column:
    items = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("-", *items)


def hash_int(seed, *parts) -> Column:
    """Unsigned 32-bit integer from the md5 of the key (as BIGINT)."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(TWO_32)


def sql_hash_int(seed_sql: str, *parts_sql: str) -> str:
    """DuckDB text of :func:`hash_int` (for the oracle)."""
    key = " || '-' || ".join([f"CAST({seed_sql} AS VARCHAR)"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


TWO_53 = 9007199254740992.0


def fast_uniform(seed, *parts) -> Column:
    """Uniform in [0, 1) from Spark's native ``xxhash64`` of (seed, parts):
    no string building, stays in codegen.  Used by the samplers, which are
    compared with the quadrature rather than with SQL."""
    cols = [F.lit(seed)] + [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(9007199254740992)).cast("double") / F.lit(TWO_53)
