import zlib

import numpy as np
from pyspark.sql import functions as F

from adlytics.llm import op3_quality as op
from .helpers import documents, with_clashes


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = op.op3_quality(spark, sf).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3).astype(int) == out.predicted).all()
    j = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    j = j[j.held_out]
    assert (j.predicted == j.quality).mean() > 0.97
    assert (j[j.quality == 0].predicted == 0).mean() > 0.9
    assert (j[j.quality == 1].predicted == 1).mean() > 0.98


def test_reruns_agree_and_edge_rows(spark):
    rows = [(i, "good plain text goes on here" if i % 2 else "BAD!! BAD!! $$$ ### BAD!!") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "w " * 30_000), (None, "x"), (1, "good plain text goes on here")]
    docs = with_clashes(documents(spark, rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (1, 1)], "doc_id long, label int")
    a = op.score(docs, op.train(docs, labels)).orderBy("doc_id", "score").collect()
    b = op.score(docs, op.train(docs, labels)).orderBy("doc_id", "score").collect()
    assert a == b and len(a) == len(rows)
    by = {x.doc_id: x.score for x in a}
    assert by[1] > 0.5 > by[0] and all(0 <= x.score <= 1 for x in a)


def test_no_labels_and_empty_table(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [x.score for x in op.score(docs, op.train(docs, none)).collect()] == [0.5, 0.5]
    empty = documents(spark, [])
    assert op.score(empty, op.train(empty, none)).count() == 0


def test_network_learns_a_circle():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 2))
    y = ((x ** 2).sum(1) < 1.2).astype(float)
    net = op.train_network(x, y)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.95
    assert 0.25 <= net.temperature <= 8


def test_neighbours_tell_repetition():
    from adlytics.llm.common import byte_table
    table = byte_table(op.SHAPE_SEED)
    vectors = op.unit_vectors(np.zeros((2 * op.BUCKETS, op.DIM)), op.index_vectors())
    text = b"same same same same one two three four"
    x = op.pooled(np.frombuffer(text, np.uint8), np.array([0, 19, len(text)]), table, vectors)
    assert x.shape[0] == 2 and x[0, op.DIM + 1] > 0.99 > x[1, op.DIM + 1]
    assert F is not None
