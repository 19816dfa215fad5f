"""URL rules decided by one bit-parallel wildcard automaton.

Every rule (host, path) becomes two globs over the canonical URL ``host+path``:
``host path*`` and ``*.host path*``, where the leading star stands for any
characters but ``/``.  All globs are packed into one Shift-And automaton: a
state per glob position, the states of all globs side by side in 64-bit words.
For each byte c of the URL

    D = ((D << 1) & ADVANCE[c]) | (D & STAY[c])

with carries between words; ADVANCE holds the literal states that c enters,
STAY the states with a star that accepts c.  A batch of URLs steps together,
one byte position at a time.  The longest accepting rule wins.

Null, ``://``-free and empty URLs have empty host and path; no rule fits them
and they get the default verdict.  Repeated rows are judged alike.  Columns of
the input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import ascii_lower, load, text_bytes


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rule set of the contract, fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DEFAULT = "allow"


@dataclass
class Automaton:
    advance: np.ndarray  # (256, words): states a byte enters from the state before
    stay: np.ndarray     # (256, words): states that a byte leaves unchanged
    start: np.ndarray    # (words,)
    accept: np.ndarray   # (globs, words)
    glob_rule: np.ndarray  # rule index of each glob


def build(rules: tuple[Rule, ...]) -> Automaton:
    globs = []
    for k, r in enumerate(rules):
        tail = (r.host + r.path).encode()
        globs += [(k, False, tail), (k, True, b"." + tail)]
    words = (sum(len(lit) + 1 for _, _, lit in globs) + 63) // 64 or 1
    advance, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, accept = np.zeros(words, np.uint64), np.zeros((len(globs), words), np.uint64)
    state = 0
    for g, (_, lead, literal) in enumerate(globs):
        w, bit = divmod(state, 64)
        start[w] |= np.uint64(1 << bit)
        if lead:  # the host star: everything but '/'
            stay[np.arange(256) != 0x2F, w] |= np.uint64(1 << bit)
        for c in literal:
            state += 1
            w, bit = divmod(state, 64)
            advance[c, w] |= np.uint64(1 << bit)
        stay[:, w] |= np.uint64(1 << bit)  # the path star
        accept[g, w] = np.uint64(1 << bit)
        state += 1
    return Automaton(advance, stay, start, accept, np.array([k for k, _, _ in globs]))


def matches(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(urls, globs) booleans; URLs step together, longest first."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, length = offsets[:-1][order], length[order]
    d = np.repeat(auto.start[None, :], len(order), axis=0)
    alive = len(order)
    for i in range(int(length[0]) if len(length) else 0):
        alive = int(np.searchsorted(-length[:alive], -i, side="left"))  # URLs longer than i
        c = data[begin[:alive] + i]
        cur = d[:alive]
        moved = cur << np.uint64(1)
        moved[:, 1:] |= cur[:, :-1] >> np.uint64(63)
        d[:alive] = (moved & auto.advance[c]) | (cur & auto.stay[c])
    hit = np.empty((len(order), len(auto.accept)), bool)
    hit[order] = (d[:, None, :] & auto.accept[None, :, :]).any(axis=2)
    return hit


def judge(rules: tuple[Rule, ...], default: str):
    auto = build(rules)
    # longest rule last, so that it overwrites shorter ones
    ranked = sorted(range(len(auto.glob_rule)), key=lambda g: len(rules[auto.glob_rule[g]].text))
    names = np.array([r.text for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [default], object)

    def step(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("_canonical"))
            hit = matches(auto, data, offsets)
            best = np.full(len(hit), len(rules))
            for g in ranked:
                best[hit[:, g]] = auto.glob_rule[g]
            rest = [i for i, f in enumerate(batch.schema) if f.name != "_canonical"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in rest] + [pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                names=[batch.schema[i].name for i in rest] + ["rule", "verdict"])

    return step


def split_url(url):
    """(host, path) columns of the contract."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, parts, 1)), F.regexp_extract(whole, parts, 2)


def url_filter(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict.  Two rules of
    equal length: the later one of the tuple wins."""
    host, path = split_url(F.col(url_col))
    df = df.drop("_canonical", "rule", "verdict", *[c for c in ("host", "path") if c != url_col])
    df = df.withColumns({"_host": host, "_path": path}).withColumns({"host": F.col("_host"), "path": F.col("_path")})
    df = df.drop("_host", "_path").withColumn("_canonical", F.concat("host", "path"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_canonical"]
    return df.mapInArrow(judge(tuple(rules), default), ", ".join([*fields, "rule string", "verdict string"]))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
