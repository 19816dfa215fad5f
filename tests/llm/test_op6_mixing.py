import hashlib
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from adlytics.llm import op6_mixing as op
from adlytics.oracle.check import compare, duck
from .helpers import documents, rng, vocabulary, with_clashes, words


def targets(sizes):
    """Sources in order -> target, by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            out.update({s: weight[s] * level for s in free})
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= 2 * sizes[s]
            free.remove(s)
    return out


def draw(doc_id, text):
    of_text = "null" if text is None else hashlib.md5(text.encode()).hexdigest()
    return int(hashlib.md5(f"{op.SEED}:{'null' if doc_id is None else doc_id}:{of_text}".encode()).hexdigest()[:13], 16) / 2 ** 52


@pytest.mark.parametrize("sources", [["a", "b", "c"], ["a"], ["é", "Z", "a", None, "b", "c", "d"], ["a", "b", "hollow"]])
def test_equals_brute_force(spark, sources):
    r = rng(len(sources))
    voc = vocabulary(r)
    data = [(i, words(r, r.randint(0, 30) * (1 if k else 9), voc) if s != "hollow" else "  ", s)
            for k, s in enumerate(sources) for i in range(100 * k, 100 * k + 40)]
    data += [(1, None, "a"), (None, "x y", "a"), (3, "\x0b\x1f one", "a"), (3, "\x0b\x1f one", "a")]
    df = with_clashes(spark.createDataFrame(data, "doc_id long, text string, source string"))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for _, t, s in data:
        per[s] = per.get(s, 0) + size(t)
    want = targets(per)
    got = op.plan_mix(df).collect()
    assert len(got) == len(data)
    for x in got:
        rate = float(want[x.source]) / per[x.source] if per[x.source] else 0.0
        assert x.source_size == per[x.source] and abs(x.target - float(want[x.source])) <= 1e-6 * max(1, x.target)
        assert x["size"] == size(x.text)
        if abs(draw(x.doc_id, x.text) - (rate - int(rate))) > 1e-9:
            assert x.copies == int(rate) + (draw(x.doc_id, x.text) < rate - int(rate))
        assert x.copies <= 2
    assert op.emit_mix(op.plan_mix(df)).count() == sum(x.copies for x in got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_without_ids_the_mix_comes_near_its_targets(spark, doc_id):
    """3,000 documents that have no id, or share one, in three equal sources."""
    data = [(doc_id, f"word{i} " * 4, "abc"[i % 3]) for i in range(3000)]
    got = op.plan_mix(spark.createDataFrame(data, "doc_id long, text string, source string")).groupBy("source", "target").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(got) == 3 and all(abs(x.taken - x.target) < 0.06 * x.target for x in got)


def test_empty_table(spark):
    assert op.plan_mix(documents(spark, [])).count() == 0


def test_near_targets_and_oracle(spark):
    sf = "/root/testdata/sf0.1"
    out = op.op6_mix_sources(spark, sf).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    src = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    per = out.merge(src, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() / per.target).max() < 0.15
    ok, why = compare(out, duck(sf).sql(op.ORACLE).df())
    assert ok, why
    assert duckdb is not None
