"""Compare a registered query with its DuckDB oracle on one data directory.

Used by the tests and by hand: ``python -m adlytics.oracle.check sf_dir [names]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb
import pandas as pd

from adlytics.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLE_NAMES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return round(float(v), 6)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = _rows(spark_pdf), _rows(oracle_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"first differing row {i}:\n spark ={x}\n oracle={y}"
    return True, f"{len(a)} rows equal"


def run(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    from adlytics.plans.registry import all_queries
    qs = all_queries()
    con = duck(sf_dir)
    res = {}
    for name, q in qs.items():
        if names and name not in names:
            continue
        sql = q.oracle_sql()
        try:
            sp = q.run(spark, sf_dir).toPandas()
        except Exception as e:  # pragma: no cover - reported
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            if verbose:
                print(name, res[name], flush=True)
            continue
        if sql is None:
            res[name] = f"rows-only ({len(sp)} rows)"
        else:
            try:
                od = con.sql(sql).df()
                ok, msg = compare(sp, od)
                res[name] = ("OK " if ok else "MISMATCH ") + msg
            except Exception as e:
                res[name] = f"ORACLE ERROR {type(e).__name__}: {str(e)[:400]}"
        if verbose:
            print(name, res[name], flush=True)
    return res


if __name__ == "__main__":  # pragma: no cover
    from adlytics.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    out = run(spark, sf, names)
    bad = [k for k, v in out.items() if not (v.startswith("OK") or v.startswith("rows-only"))]
    print("FAILED:", bad)
