import math

import numpy as np
import pytest

from adlytics.llm import op7_exact_search as op
from adlytics.oracle.check import compare, duck


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(float(np.float32(x)) * 256) for x in v)] = None
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def rows(n=400, dim=8, seed=1):
    r = np.random.default_rng(seed)
    out = [(i, [float(x) for x in r.normal(size=dim)]) for i in range(n)]
    out += [(n + i, out[7][1]) for i in range(30)]                       # ties
    out += [(n + 100, None), (n + 101, [None] * dim), (n + 102, [float("nan")] * dim), (n + 103, [float("inf")] * dim),
            (n + 104, []), (n + 105, [1.0]), (7, out[7][1]), (None, out[3][1]), (50, out[50][1])]
    return out


@pytest.mark.parametrize("pivots, rings, wave, sample", [(32, 16, 24, 8192), (4, 3, 1, 20), (1, 1, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, pivots, rings, wave, sample):
    monkeypatch.setattr(op, "PIVOTS", pivots)
    monkeypatch.setattr(op, "RINGS", rings)
    monkeypatch.setattr(op, "WAVE", wave)
    monkeypatch.setattr(op, "SAMPLE", sample)
    monkeypatch.setattr(op, "PIECE", 64)
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>").selectExpr("*", "1 as ring", "'x' as v", "0 as score")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in op.top_k(df, lambda c: c % 50 == 0).collect())
    assert got == brute(rows())


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert op.top_k(spark.createDataFrame([], kind), lambda c: c % 50 == 0).count() == 0
    assert op.top_k(spark.createDataFrame([(0, [1.0])], kind), lambda c: c % 50 == 0).count() == 0
    got = op.top_k(spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5])], kind), lambda c: c % 50 == 0).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_bounds_hold():
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(3000, 6)) * 200).astype(np.int64)
    top = float((x * x).sum(1).max())
    index = op.Index(x[:500], 6, top, float(np.abs(x).max()))
    ring, bound, score = index.ring(x), index.bounds(x[:50]), x[:50] @ x.T
    assert (score <= bound[:, ring]).all()


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    ok, why = compare(op.op7_exact_search(spark, sf).toPandas(), duck(sf).sql(op.ORACLE).df())
    assert ok, why
