import hashlib

import numpy as np

from adlytics.llm import op2_fingerprint as op
from adlytics.llm.common import byte_table
from .helpers import documents, rng, vocabulary, with_clashes, words


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def edits(df):
    return sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in op.edited_pairs(df).collect()), key=str)


def test_edited_texts(spark):
    r = rng(2)
    voc = vocabulary(r)
    rows = [(i, words(r, r.randint(0, 200), voc)) for i in range(300)]
    rows += [(-5, "é😀" * 50), (10_000, None), (7, "again"), (7, "again"), (None, "no id"), (None, "none either"), (50_000, "x" * 100_000)]
    assert edits(with_clashes(documents(spark, rows))) == expected_edits(rows)


def test_small_tables(spark):
    assert op.edited_pairs(documents(spark, [])).count() == 0
    for rows in ([(3, "alone")], [(None, "a")], [(None, "a"), (None, "b")], [(1, None), (None, "b")], [(1, "same"), (1, "same")]):
        assert edits(documents(spark, rows)) == expected_edits(rows)


def fingerprint(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return op.fingerprints(raw, np.array([0, len(raw)]), byte_table(op.GEAR_SEED), byte_table(op.GEAR_SEED + 1))[0]


def test_blocks_do_not_change_fingerprints(spark):
    r = rng(4)
    texts = [words(r, n, vocabulary(r)) for n in (0, 1, 3, 50, 500, 0, 2, 9)]
    got = {x.doc_id: x.fingerprint for x in op.fingerprint_column(documents(spark, list(enumerate(texts))).coalesce(1)).collect()}
    assert [got[i] for i in range(len(texts))] == [op.encode(fingerprint(t)) for t in texts]


def test_likeness():
    r = rng(6)
    text = words(r, 600, vocabulary(r))
    other = words(rng(7), 600, vocabulary(rng(8)))
    a = fingerprint(text)
    assert op.likeness(a, a) == 1.0
    assert op.likeness(a, fingerprint("one more word " + text)) > 0.9         # a shift moves few borders
    assert op.likeness(a, fingerprint(text[:len(text) // 2])) > 0.9            # contained
    assert 0.35 < op.likeness(a, fingerprint(text[:len(text) // 2] + other[:len(text) // 2])) < 0.65
    assert op.likeness(a, fingerprint(other)) < 0.02
    empty = fingerprint("")
    assert op.likeness(empty, empty) == 1.0 and op.likeness(a, empty) == 0.0
    assert max(a & np.uint64(0xFF)) <= op.MAXIMUM


def test_query(spark):
    out = op.op2_fingerprint(spark, "/root/testdata/sf0.01").toPandas()
    long = out[out.n_chars > 500]
    assert (long.near_edited > 0.3).mean() > 0.95 and (long.near_next < 0.1).mean() > 0.95
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
