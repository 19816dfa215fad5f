import hashlib
import math

import numpy as np
import pytest

from adlytics.llm import op11_vector_codes as op
from adlytics.oracle.check import compare, duck

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python integers, every distance."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dim = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    limit = math.isqrt((2 ** 63 - 1) // (4 * max(dim, 1)))
    kept = [(i, [min(max(x, -limit), limit) for x in v] + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // parts

    def piece(v, p):
        return v[p * w:(p + 1) * w]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    books = [[piece(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(piece(v, p), books[p])[1], []).append(piece(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, lab, [near(piece(v, p), books[p]) for p in range(parts)]) for i, v, lab in kept]
    total = {}
    for _, lab, n in found:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in n)
    text = ",".join(str(x) for book in books for c in book for x in c)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[lab], sha) for i, lab, n in found]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as code", "0L as error", "1 as part", "2 as entry", "3 as n")
    return [tuple(r) for r in op.vector_codes(df, **kw).collect()]


def order(rows):
    return sorted(rows, key=repr)


def rows(n=90, dim=8, seed=3, scale=1.0):
    r = np.random.default_rng(seed)
    out = [(i * 3 % 97, [float(x) * scale for x in r.normal(size=dim)], int(r.integers(3)) if i % 5 else None) for i in range(n)]
    out += [(200 + i, out[4][1], 1) for i in range(40)]                      # ties
    out += [out[5], out[5], (None, out[6][1], 2), (None, out[7][1], None)]   # repeats, null ids
    out += [(300, None, 1), (301, [None] * dim, 1), (302, [1.0, float("nan")], 1), (303, [float("-inf")], 1)]
    return out


@pytest.mark.parametrize("entries, rounds, scale", [(256, 4, 1.0), (7, 4, 1.0), (7, 1, 1e4), (16, 2, 1e30)])
def test_equals_brute_force(spark, entries, rounds, scale):
    data = rows(scale=scale)
    assert order(run(spark, data, entries=entries, rounds=rounds)) == order(brute(data, entries=entries, rounds=rounds))


def test_other_lengths(spark):
    """Short and empty vectors, and a dimension the parts do not divide."""
    data = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5, -0.25, 3.0, 4.0, 5.0], None), (4, [-1.5], 2)]
    assert order(run(spark, data)) == order(brute(data))
    assert order(run(spark, [(1, [], 5), (2, [], 5)])) == order(brute([(1, [], 5), (2, [], 5)]))


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


def test_hot_label(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 3)  # labels from a third of all rows on are hot
    data = [(i, [float(i), 0.0, 1.0, 2.0], None if i % 2 else i) for i in range(60)]
    assert order(run(spark, data, rounds=1)) == order(brute(data, rounds=1))


@pytest.mark.parametrize("dim, top", [(1, 2 ** 31), (16, 2 ** 29), (64, 2 ** 28), (16, 5), (3, 2 ** 25)])
def test_exact_products(dim, top):
    r = np.random.default_rng(dim)
    x, c = r.integers(-top, top, (50, dim)), r.integers(-top, top, (20, dim))
    x[0], c[0], x[1] = top, -top, -top
    want = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c] for u in x], dtype=object)
    for width in (None, 5, 12):  # any width that keeps sums below 2^53
        assert (op.exact_dots(x, c, width).astype(object) == want).all()


@pytest.mark.parametrize("dim", [1, 2, 16, 17, 4096])
def test_limbs_hold_the_number(dim):
    width = op.limb_width(dim)
    assert dim * (1 << 2 * width) <= 1 << 53
    x = np.array([0, 1, -1, 2 ** 40 + 12345, -2 ** 40 - 999, 2 ** 62, -2 ** 62])
    parts = op.limbs(x, width)
    assert all(np.abs(p).max() <= 1 << width for p in parts)
    assert [sum(int(p[i]) << (width * k) for k, p in enumerate(parts)) for i in range(len(x))] == x.tolist()


def test_first_of_equals():
    book = np.array([[5, 5], [0, 0], [0, 0], [2, 0]])
    best, far = op.assign(np.array([[0, 0], [1, 0], [5, 5]]), book)
    assert best.tolist() == [1, 1, 0] and far.tolist() == [0, 1, 0]


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    ok, why = compare(op.op11_vector_codes(spark, sf).toPandas(), duck(sf).sql(op.ORACLE).df())
    assert ok, why
