import zlib

import numpy as np

from adlytics.llm import op10_language_id as op
from .helpers import with_clashes

KIND = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = op.op10_language_id(spark, sf).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    j = out.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (j[j.held_out].lang_pred == j[j.held_out].lang).mean() > 0.99
    assert j.score.between(0, 1).all() and j.rejected.mean() < 0.005


def test_edge_rows(spark):
    train = [(i, f"the quick brown fox number {i} jumps over the lazy dog again and again", "en") for i in range(40)]
    train += [(100 + i, f"der schnelle braune fuchs nummer {i} springt über den faulen hund", "de") for i in range(40)]
    train += [(200, "unlabelled", None), (201, None, "en"), (None, "the dog", "en")]
    rows = [(1, None, None), (2, "", None), (3, " 12 !? ", None), (4, "the lazy dog jumps", None), (5, "der faule hund springt über", None),
            (5, "der faule hund springt über", None), (6, "дом на холме у реки стоит давно и тихо", None), (None, "THE DOG", None), (7, "the dog " * 20_000, None)]
    got = op.identify(with_clashes(spark.createDataFrame(rows, KIND)), spark.createDataFrame(train, KIND)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred == "en" and by[5].lang_pred == "de" and by[None].lang_pred == "en" and by[7].lang_pred == "en"
    assert by[6].lang_pred in ("en", "de") and by[6].rejected and not by[4].rejected


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    docs = spark.createDataFrame([(1, "abc", None)], KIND)
    assert [(x.lang_pred, x.rejected) for x in op.identify(docs, none).collect()] == [("und", True)]
    assert op.identify(none, none).count() == 0


def test_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    codes = r.integers(97, 101, (500, op.ORDER))
    codes, counts = np.unique(codes, axis=0, return_counts=True)
    models = op.fit_models(["a"], np.zeros(len(codes), np.int64), codes, counts.astype(float))
    for context in codes[:20, :-1]:
        total = 0.0
        for c in list(range(97, 101)):
            s = np.append(context, c).astype(np.uint32)
            total += np.exp(models.log_probs(s, np.array([op.ORDER - 1]))[0, 0])
        total += np.exp(models.log_probs(np.append(context, 120).astype(np.uint32), np.array([op.ORDER - 1]))[0, 0])
        assert abs(total - 1) < 1e-4


def test_sorted_hashes():
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 2 ** 64, 5000, dtype=np.uint64))
    table = op.SortedHashes(keys, np.zeros((len(keys), 1)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    absent = np.setdiff1d(r.integers(0, 2 ** 64, 5000, dtype=np.uint64), keys)
    assert (table.find(absent) == -1).all()
    assert table.find(np.array([2 ** 64 - 1], np.uint64)).tolist() == [-1]


def test_many_languages(spark):
    """More than 200 values of lang, none of them lost."""
    names = [f"l{k:03d}" for k in range(201)]
    train = [(k * 10 + i, f"w{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)} " * (3 + i), names[k]) for k in range(201) for i in range(6)]
    docs = [(5000 + k, f"w{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)} " * 5, None) for k in range(201)]
    got = {x.doc_id: x.lang_pred for x in op.identify(spark.createDataFrame(docs, KIND), spark.createDataFrame(train, KIND)).collect()}
    assert [got[5000 + k] for k in range(201)] == names
