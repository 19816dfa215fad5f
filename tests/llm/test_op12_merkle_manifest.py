import hashlib
import zlib

import pytest

from adlytics.llm import op12_merkle_manifest as op
from adlytics.oracle.check import compare, duck

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return h(*[field(v) for v in (doc_id, source, lang, n, text)])


def tree(hashes):
    """Root, and the siblings (before, after) of each leaf, level by level."""
    paths = [[] for _ in hashes]
    nodes = [(x, [i]) for i, x in enumerate(hashes)]
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1:])))
            up.append((h(*[x for x, _ in run]), [i for _, b in run for i in b]))
        nodes = up
    return nodes[0][0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for s in names:
        docs = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, paths = tree([leaf(r, r[1]) for r in docs])
        subs.append(sub)
        found.append((docs, paths))
    root, tops = tree(subs)
    out = []
    for (docs, paths), sub, top in zip(found, subs, tops):
        for r, path in zip(docs, paths):
            path = path + top
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf(r, text)
            for before, after in path:
                acc = h(before, acc, after)
            out.append((r[0], leaf(r, r[1]), sub, root, h(*[x for p in path for x in p]), acc, acc == root))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as tree", "1 as rank", "2 as n", "'y' as hash", "'z' as kids", "0 as _row")
    found = op.merkle_manifest(df, op.without_line_ends).drop("path")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def rows():
    out = [(i * 7 % 60, f"line {i}\nnext é中" * (i % 4), "en", "hot", i) for i in range(60)]
    out += [(100 + i, "a\nb", None, s, None) for i, s in enumerate([None, None, "", "é", "z", "Z", "a" * 40, "lone"])]
    out += [(None, "x\ny", "en", "hot", 3), (None, None, None, "hot", None), (None, None, None, None, None)]
    out += [(3, "other", "en", "hot", 1)] + [(5, "same\n", "en", "hot", 5)] * 4   # an id of several texts, equal rows
    out += [(500, "very long\n" * 50_000, "en", "long", 1), (-4, "", "en", "long", 0)]
    return out


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_equals_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(op, "DIGITS", digits)  # blocks of 3, 9, 729 nodes: several tiers, one tier
    got = run(spark, rows())
    assert got == brute(rows())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_few_rows(spark):
    assert run(spark, []) == []
    one = [(1, "t", "en", "s", 1)]
    got = run(spark, one)
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()
    for n in (2, 3, 4):
        some = [(i, "t", "en", None, i) for i in range(n)]
        assert run(spark, some) == brute(some)


def test_changed_leaf_is_found(spark):
    """Whatever a document's text becomes, its fold no longer meets the root."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(30)], KIND)
    found = op.merkle_manifest(df, lambda doc_id, text: F.when(doc_id == 17, F.concat(text, F.lit(" "))).otherwise(text))
    assert [r.doc_id for r in found.filter("not verified").collect()] == [17]


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    ok, why = compare(op.op12_merkle_manifest(spark, sf).toPandas(), duck(sf).sql(op.ORACLE).df())
    assert ok, why
