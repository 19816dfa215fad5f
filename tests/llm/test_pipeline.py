"""Each stage against a plain version of itself, on what its predecessor kept."""

import corpus_pipeline as p
from adlytics.llm import op4_jaccard_join as op4, op6_mixing as op6
from . import test_op4_jaccard_join as near, test_op9_personal_data as pii
from .helpers import documents, rng, vocabulary, with_clashes, words

SF = "/root/testdata/sf0.001"


def stage(k, spark, docs):
    return p.STAGES[k][1](spark, docs, SF)


def test_stage_names_and_columns(spark):
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "tokens"]
    docs = with_clashes(spark.read.parquet(f"{SF}/documents.parquet").limit(60))
    for k in range(4):
        docs = stage(k, spark, docs)
        assert tuple(docs.columns) == p.COLUMNS
    assert "ids" in stage(4, spark, docs).columns


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    language = stage(0, spark, docs).toPandas()
    assert len(language) >= 0.99 * docs.count()
    out = p.run(spark, SF).toPandas()
    assert out.round_trip.all() and set(out.doc_id) <= set(language.doc_id) and (out.ids.map(len) == out.n_tokens).all()


def test_near_duplicate_stage(spark):
    r = rng(13)
    voc = vocabulary(r)
    rows = []
    for _ in range(30):
        base = words(r, 80, voc).split()
        for _ in range(r.randint(1, 6)):
            t = list(base)
            t[r.randrange(80)] = "edited"
            rows.append((len(rows), " ".join(t)))
    kept = sorted(x.doc_id for x in stage(1, spark, documents(spark, rows)).collect())
    assert kept == sorted({c for _, _, c in near.brute(rows, op4.Rule(5, 8, 10))})


def test_personal_data_stage(spark):
    rows = [(1, "mail a.b@site.example or +1 (555) 123-4567"), (2, "nothing here"), (3, None)]
    got = {x.doc_id: x for x in stage(2, spark, documents(spark, rows)).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here" and got[3].text == ""
    assert not any(pii.base(x.text) for x in got.values())


def test_mix_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(x.doc_id, x.copies) for x in op6.plan_mix(docs).collect() if x.copies}
    got = {(x.doc_id, x["count"]) for x in stage(3, spark, docs).groupBy("doc_id").count().collect()}
    assert got == want


def test_empty_documents(spark):
    docs = documents(spark, [])
    for k in range(5):
        assert stage(k, spark, docs).count() == 0


def test_executors_need_no_package(tmp_path):
    """The tasks run in workers that cannot import the library."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path
    root = str(Path(p.__file__).parent)
    (tmp_path / "run.py").write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        from adlytics.llm.queries import QUERIES
        for name, query in QUERIES.items():
            assert query(spark, {SF!r}).count() > 0, name
        print("ALL RAN")
    """))
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RAN" in done.stdout, done.stderr[-2000:]
