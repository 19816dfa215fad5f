import hashlib
from collections import Counter

import numpy as np
import pytest

from adlytics.llm import op1_suffix_dedup as op
from .helpers import documents, rng, with_clashes


def brute(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[j:j + 200] for j in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j:j + 200]] > 1:
                gone[j:j + 200] = b"\1" * 200
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = rng(5)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [text(k) for k in (199, 200, 201, 230, 350, 1200)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "w" * 1000, "ab" * 300, text(5000), "\0" * 300 + text(50) + "\0" * 250, text(60_000)]
    for _ in range(150):
        t = text(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            t += p[r.randint(0, 30) if r.random() < .5 else 0:len(p) - (r.randint(0, 30) if r.random() < .5 else 0)] + text(r.randint(0, 60))
        out.append(t)
    out += [out[20], out[20], out[30]]
    return list(enumerate(out)) + [(5, out[5]), (40, out[40])]


@pytest.mark.parametrize("hot", [op.HOT, 20, 1])
def test_equals_brute_force(spark, hot):
    data = rows()
    got = [(x.doc_id, x.n_bytes, x.n_removed, len(x.removed), hashlib.sha256(bytes(x.kept)).hexdigest())
           for x in op.remove_repeats(with_clashes(documents(spark, data)), hot).collect()]
    assert sorted(got, key=str) == brute(data)


def test_empty_table_and_null_id(spark):
    assert op.remove_repeats(documents(spark, [])).count() == 0
    one = op.remove_repeats(documents(spark, [(None, "a" * 300)])).collect()[0]
    assert one.doc_id is None and one.n_removed == 300


def test_many_equal_rows_without_id(spark):
    """Equal rows go as a whole, once searched, and count for the other rows."""
    r = rng(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(2300))
    other = [(7, "begin " + text[500:900] + " end"), (8, text[:150]), (None, "z" * 120)]
    rows = [(None, text)] * 10_000 + [(None, "short")] * 3 + [(3, text)] * 2 + other
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, len(x.removed)) for x in op.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2300, 2300, 1)] * 10_000 + [(None, 5, 0, 0)] * 3 + [(3, 2300, 2300, 1)] * 2
                         + [(7, 410, 400, 1), (8, 150, 0, 0), (None, 120, 0, 0)], key=str)


def test_merge_equals_sort():
    r = rng(3)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 30))).encode() for _ in range(300)]
    for n_runs in (1, 2, 3, 7, 16):
        parts = [sorted(strings[i::n_runs]) for i in range(n_runs)]
        runs = [iter(list(zip(op.common_prefixes(p).tolist(), p))) for p in parts]
        order, shared = op.merge_runs(runs)
        at = [iter(p) for p in parts]
        merged = [next(at[i]) for i in order]
        assert merged == sorted(strings)
        assert shared == op.common_prefixes(merged).tolist()


def test_runs_round_trip():
    rights = sorted([b"abc", b"abd", b"abd", b"", b"z" * 200])
    lefts = [b"x", b"", b"y" * 159, b"q", b"r"]
    groups = [[[1, 2, 3, 3]], [[4, 5, 6, 9], [7, 8, 9, 9]], [[1, 1, 1, 1]], [[2, 2, 2, 2]], [[3, 3, 3, 8]]]
    suffixes, left_size, left, times, chains, places = op.unpack_run(op.pack_run(rights, lefts, [1, 4, 1, 1, 3], groups))
    assert [s for _, s in suffixes] == rights
    assert left_size.tolist() == [1, 0, 159, 1, 1] and times.tolist() == [1, 4, 1, 1, 3] and chains.tolist() == [1, 2, 1, 1, 1]
    assert np.array_equal(places, [p for g in groups for p in g])


def test_query_on_given_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in d])
