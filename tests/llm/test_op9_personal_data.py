import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from adlytics.llm import op9_personal_data as op
from .helpers import documents, rng, with_clashes


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, text or "") if ok(m.group()))


def found(df):
    spans = F.concat(*[op.names(F.col(k), k) for k in op.KINDS])
    return op.detect(df).withColumn("base", F.array_join(spans, ",")).withColumn("clean", op.sanitised(F.col("text"))).collect()


def test_base_spans_equal_brute_force(spark):
    r = rng(3)
    parts = list("ab1 2.3@-+()9 _%\n") + ["4111 1111 1111 1111", "4111111111111111", "a@b.c", "1.2.3.4", "255.255.256.1", "+1 (555) 123-4567",
                                         op.DOT, op.CUT, op.SEP, "é", "😀", "x.y@z-.w", "..", "000255.1.1.1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 2000, "1" * 2000, "1." * 1000, "+1" + " " * 1000, "a@" + "b." * 500 + "c", "1 " * 1000, "a@b.c_" * 200]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a@b.c")]
    got = found(with_clashes(documents(spark, rows)))
    assert len(got) == len(rows)
    text = dict(rows)
    for x in got:
        assert x.base == base(text[x.doc_id])


def test_long_texts_are_linear(spark):
    rows = list(enumerate(["a" * 200_000, "1" * 200_000, "a@" + "b." * 50_000 + "c", "1 " * 100_000, "a@" * 100_000, "+" * 100_000]))
    assert len(found(documents(spark, rows))) == len(rows)


def test_disclosing_words(spark):
    same = [(i, f"text {'abcdefgh'[i]} by Quentin Foobar mail q.f@site.example now number {'ijklmnop'[i]}") for i in range(8)]
    rest = [(1000 + i, f"mail from someone number {i} here {'xyzw'[i % 4]}") for i in range(400)]
    copies = [(200 + i, "copied word Unicorn mail u@site.example") for i in range(20)]  # one text only
    got = {x.doc_id: x for x in found(documents(spark, same + rest + copies))}
    text = dict(same)
    for i, t in same:
        terms = [t[s.start:s.end] for s in got[i].term]
        assert "Foobar" in terms and "Quentin" in terms and "mail" not in terms and "number" not in terms
        assert "q.f@site.example" not in got[i].clean and "Foobar" not in got[i].clean and "[EMAIL]" in got[i].clean
        assert got[i].base == base(text[i])
    assert all(not got[i].term and got[i].clean == t for i, t in rest)
    assert all(not got[i].term for i, _ in copies)


def test_empty_table_and_query(spark):
    assert op.detect(documents(spark, [])).count() == 0
    sf = "/root/testdata/sf0.01"
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in op.op9_personal_data(spark, sf).collect():
        b = base(text[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(b.encode()).hexdigest() and x.spans.startswith(b)
        for kind in op.KINDS:
            assert x[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in b.split(","))


def test_main_path_is_native(spark):
    df = op.op9_personal_data(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_terms(rows):
    """Positions of disclosing words by row, counted over whole texts."""
    def spans(t):
        return [(m.start(), m.end(), re.sub("[ -]", "", m.group().lower())) for _, p, ok in KINDS for m in re.finditer(p, t) if ok(m.group())]

    def words(t):
        out = list(t)
        for a, b, _ in spans(t):
            out[a:b] = "0" * (b - a)
        return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]+", "".join(out))]

    texts = {t or "" for _, t in rows}
    has = {t: ({e for _, _, e in spans(t)}, {w for _, _, w in words(t)}) for t in texts}
    alone, held, both = Counter(), Counter(), Counter()
    for e, w in has.values():
        alone.update(w)
        held.update(e)
        both.update((x, y) for x in e for y in w)
    found = set()
    for (e, w), n in both.items():
        known = math.log2(len(texts) / held[e])
        if n >= op.MIN_TEXTS and n / alone[w] >= op.MIN_SHARE and known > 0 and math.log2(n / alone[w]) + known >= op.MIN_PART * known - 1e-12:
            found.add(w)
    return [[(a, b) for a, b, w in words(t or "") if w in found] for _, t in rows]


def test_terms_far_from_the_entity_and_without_it(spark):
    """Names a sentence away, short ones, of an entity in many texts, repeated, and in other texts."""
    rows = [(i, f"Jo Foobar wrote this. {'abcdefghij'[i]} After it stands some long sentence here, then q.f@site.example {i}. FOOBAR") for i in range(10)]
    rows += [(100 + i, f"someone sees {'Foobar' if i < 3 else 'another'} with number {i} here, then other some jo{i}") for i in range(60)]
    rows += [(200 + i, f"Call Wally about it {i}, at 1.2.3.4 please") for i in range(40)]
    rows += [(None, rows[0][1]), (3, rows[4][1]), (7, None)]
    want = sorted((str(i), t or "", w) for (i, t), w in zip(rows, plain_terms(rows)))
    got = found(documents(spark, rows))
    assert sorted((str(x.doc_id), x.text, [(s.start, s.end) for s in x.term]) for x in got) == want
    assert not any(re.search("foobar|wally", x.clean, re.I) for x in got)
