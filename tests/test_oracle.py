"""Every query with an oracle: Spark result == DuckDB result (sf0.001 for
all, sf0.01 for a representative subset)."""

import pytest

from adlytics.oracle.check import compare, duck
from adlytics.plans.registry import all_queries

from conftest import SF_MID, SF_SMALL

WITH_ORACLE = [n for n, q in all_queries().items() if q.oracle is not None]
MID = ["c01_daily_kpis", "c10_conversion_feed", "c17_cpc_band_repeat", "c34_bayes_bookings_by_day",
       "x03_block_bootstrap", "c35_delay_chow", "c33_keyword_match"]


def _check(spark, queries, name, sf):
    q = queries[name]
    sp = q.run(spark, sf).toPandas()
    od = duck(sf).sql(q.oracle_sql()).df()
    ok, msg = compare(sp, od)
    assert ok, f"{name} @ {sf}: {msg}"


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_oracle_small(spark, queries, name):
    _check(spark, queries, name, SF_SMALL)


@pytest.mark.parametrize("name", MID)
def test_oracle_mid(spark, queries, name):
    _check(spark, queries, name, SF_MID)


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 60


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN",
                 "TimestampType()": "TIMESTAMP", "TimestampNTZType()": "TIMESTAMP",
                 "DecimalType(10,4)": "DECIMAL(10,4)"}


def test_oracle_column_types(spark, queries):
    """Same column names and types on both sides (schema part of the gate)."""
    con = duck(SF_SMALL)
    bad = []
    for name in WITH_ORACLE:
        q = queries[name]
        sp = {f.name: str(f.dataType) for f in q.run(spark, SF_SMALL).schema.fields}
        rel = con.sql(q.oracle_sql())
        dk = dict(zip(rel.columns, [str(t) for t in rel.types]))
        assert set(sp) == set(dk), name
        bad += [(name, c, t, dk[c]) for c, t in sp.items() if SPARK_TO_DUCK.get(t, t) != dk[c]]
    assert not bad, bad
