"""Fixtures in code: small tables with nulls, blanks, ties, repeats and clashes."""

import random

CLASHES = "core long, class long, score double, size long, email string, term string, host string, rule string, best int, run binary, bucket int"


def words(rng, n, voc):
    return " ".join(rng.choice(voc) for _ in range(n))


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def with_clashes(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    for c in CLASHES.split(", "):
        name, kind = c.split(" ")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def rng(seed=1):
    return random.Random(seed)
