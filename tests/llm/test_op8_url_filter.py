import re

import numpy as np

from adlytics.llm import op8_url_filter as op
from adlytics.oracle.check import compare, duck
from .helpers import rng, with_clashes


def expected(url, rules=op.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)) if m else ""
    path = m.group(2) if m else ""
    best = None
    for r in rules:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) >= len(best.text)):
            best = r
    return host, path, best.text if best else None, best.verdict if best else "allow"


def urls():
    r = rng(3)
    out = [None, "", "nothing", "://", "http://", "http://com", "http://com/", "http://COM/a", "x://evil.net/a.com/", "http://example.com/en/",
           "http://www.example.com/en/1?x#y", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://net/es/", "http://é.net/fr/ü",
           "a\nb://q.net/fr/", "http://a://b.com/en/", "http://x.com" + "/y" * 20_000, "ftp://.com/", "http://com./", "file:///com/", "http://u@x.com:8080/"]
    hosts, paths = ["com", "net", "example", "www", "a", "EXAMPLE"], ["en", "es", "fr", "x", "", "En"]
    for _ in range(800):
        out.append(r.choice(["http://", "https://", "://", "//"]) + ".".join(r.choice(hosts) for _ in range(r.randint(0, 4)))
                   + "".join("/" + r.choice(paths) for _ in range(r.randint(0, 3))) + r.choice(["", "/", "?q=/en/", "#en"]))
    return out


def test_equals_brute_force(spark):
    df = with_clashes(spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")).selectExpr("*", "'v' as verdict", "'p' as path")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in op.url_filter(df).collect()}
    assert got == {i: expected(u) for i, u in enumerate(urls())}


def test_many_rules_span_words():
    r = rng(5)
    rules = tuple(op.Rule(r.choice(["allow", "block"]), ".".join(r.choice("abc") for _ in range(r.randint(1, 4))), "/" + r.choice(["", "x/", "xy"]))
                  for _ in range(60))
    rules = tuple({x.text: x for x in rules}.values())
    auto = op.build(rules)
    assert auto.advance.shape[1] > 3
    texts = [(".".join(r.choice("abc") for _ in range(r.randint(1, 6))), r.choice(["/", "/x/", "/xyz", ""])) for _ in range(500)]
    raw = [(h + p).encode() for h, p in texts]
    hit = op.matches(auto, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    for row, (h, p) in zip(hit, texts):
        got = {auto.glob_rule[g] for g in np.flatnonzero(row)}
        assert got == {k for k, x in enumerate(rules) if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)}


def test_empty_table_and_oracle(spark):
    assert op.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    sf = "/root/testdata/sf0.01"
    ok, why = compare(op.op8_url_filter(spark, sf).toPandas(), duck(sf).sql(op.ORACLE).df())
    assert ok, why
