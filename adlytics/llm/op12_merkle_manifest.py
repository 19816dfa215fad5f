"""Merkle manifest of a table: leaf digests, subtree per source, root and proofs.

H is lowercase hex sha256 of its inputs concatenated.  A leaf is H of the columns,
each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  Per source leaves
ascend by id; every FAN consecutive nodes become their H until one is left.  The
subroots, ordered by source, likewise give the root.

Nested-struct rollup: a leaf's rank in its tree is written in digits of base FAN.  A
block is FAN^DIGITS consecutive ranks; all its rows are dealt to one place once, and
then the digits are grouped away one by one, from the last: a group's children
become a sorted array of structs inside their parent's struct, whose hash is that of
the children.  What is left is one row a block that holds its whole subtree, of bounded
size.  The proofs of a block come out of that row by transform and explode, digit by
digit; no row is joined with its siblings.  Blocks are the leaves of the next tier,
FAN^DIGITS times smaller, which is rolled up alike until each tree is one row.  The only
join between tiers is that of a block with the proof of its own hash, one row each,
so it has no hot key.  Sources are the leaves of one more tree.

Ranks come from range slices: rows are sorted into slices by (source, doc_id, leaf, row),
numbered within a slice, and the counts of the slices before are added.  A source that
holds a third of all rows is spread over a third of the slices.

Verification folds a leaf, or a tampered one, with its siblings back to a root.

Null ids come first; rows that share an id are ordered by their leaf, equal rows have equal
leaves, so which of them is first makes no difference.  A null id is never
tampered with.  An empty table gives no rows; a single leaf's proof is H of nothing.
Texts of any length are hashed whole.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.llm.common import load, shuffle_width, written

FAN = 3
DIGITS = 6            # a block holds at most FAN^DIGITS = 729 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame, tampered) -> DataFrame:
    """tree, doc_id, hash, changed: the leaf of each row, and that of its tampered
    text where it differs.  Trees sort as sources do, null first."""
    doc_id = F.col("doc_id").cast("long")
    other = tampered(doc_id, F.col("text"))
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree"), doc_id.alias("doc_id"),
        digest(*head, field(F.col("text"))).alias("hash"),
        F.when(~other.eqNullSafe(F.col("text")), digest(*head, field(other))).alias("changed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with rank (from 0, in their tree) and n (rows of the tree)."""
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order], "_row"]
    slices = written(rows.withColumn("_row", F.monotonically_increasing_id())
                     .repartitionByRange(shuffle_width(rows.sparkSession), *keys).withColumn("_slice", F.spark_partition_id()))
    counts = slices.groupBy("tree", "_slice").agg(F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")  # at most one row a slice
    before = F.sum("_rows").over(tree.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "_slice").orderBy(*keys[1:])) - 1
    return (slices.withColumn("_place", place).join(counts, ["tree", "_slice"])
            .withColumn("rank", F.col("_before") + F.col("_place")).drop("_row", "_slice", "_before", "_place"))


def rolled(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, n, block, hash, kids: one row a block, its subtree nested in kids."""
    digits = [f"d{i}" for i in range(DIGITS)]
    rank = F.col("rank")
    cur = nodes.select(
        "tree", "n", F.floor(rank / F.lit(FAN ** DIGITS)).alias("block"), "hash", *payload,
        *[F.floor(rank / F.lit(FAN ** i) % FAN).cast("int").alias(d) for i, d in enumerate(digits)])
    cur = cur.repartition("tree", "block")  # all groupings below find their rows together
    held = payload
    for i, d in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(d, "hash", *held))).alias("kids")
        cur = cur.groupBy("tree", "n", "block", *digits[i + 1:]).agg(kids)
        hashes = F.col("kids.hash")
        # above the top of a small tree the single node stays as it is
        cur = cur.withColumn("hash", F.when(F.col("n") > FAN ** i, digest(joined(hashes))).otherwise(hashes[0]))
        held = ["kids"]
    return cur


def tiers(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of blocks, until each tree is one row."""
    out = []
    while True:
        out.append(written(rolled(nodes, payload)))
        if out[-1].filter(F.col("n") > FAN ** DIGITS).isEmpty():
            return out
        nodes = out[-1].select("tree", F.ceil(F.col("n") / F.lit(FAN ** DIGITS)).alias("n"), F.col("block").alias("rank"), "hash")
        payload = []


def unrolled(blocks: DataFrame, paths: DataFrame, payload: list[str]) -> DataFrame:
    """A row for each node of the blocks: rank, hash, payload, and its path to the root.
    ``paths``: tree, block, path (of the block's own hash) and columns to carry."""
    carried = [c for c in paths.columns if c not in ("tree", "block", "path")]
    cur = blocks.drop("hash").join(paths, ["tree", "block"]).withColumnRenamed("block", "rank")
    for i in reversed(range(DIGITS)):
        cur = cur.select("tree", "n", "rank", "path", *carried, F.col("kids.hash").alias("_all"), F.posexplode("kids").alias("_at", "_kid"))
        step = F.struct(joined(F.slice("_all", F.lit(1), F.col("_at"))).alias("before"),
                        joined(F.slice("_all", F.col("_at") + 2, F.lit(FAN))).alias("after"))
        held = ["kids"] if i else payload
        cur = cur.select(
            "tree", "n", *carried, (F.col("rank") * FAN + F.col(f"_kid.d{i}")).alias("rank"), F.col("_kid.hash").alias("hash"),
            F.when(F.col("n") > FAN ** i, F.concat(F.array(step), "path")).otherwise(F.col("path")).alias("path"),
            *[F.col(f"_kid.{c}").alias(c) for c in held])
    return cur.drop("n")


def descended(levels: list[DataFrame], paths: DataFrame, payload: list[str]) -> DataFrame:
    """The paths of all leaves; ``paths``: tree, path of its top and columns to carry."""
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(levels))):
        found = unrolled(levels[k], paths, [] if k else payload)
        if k:
            paths = found.withColumnRenamed("rank", "block").drop("hash")
    return found


def folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def merkle_manifest(docs: DataFrame, tampered) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path.
    ``tampered(doc_id, text)`` gives the text to verify."""
    spark = docs.sparkSession
    rows = written(leaves(docs, tampered))
    if rows.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         f"folded_root string, verified boolean, path {PATH}")
    levels = tiers(ranked(rows, ["doc_id", "hash"]), ["doc_id", "changed"])
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    above = tiers(ranked(subroots, ["of"]), ["of"])
    root = above[-1].select("tree", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descended(above, root, ["of"]).select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    found = descended(levels, tops, ["doc_id", "changed"]).withColumnRenamed("hash", "leaf")
    siblings = F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"])))
    return found.select(
        "doc_id", "leaf", "subroot", "root", digest(joined(siblings)).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"), "path").withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """Texts of ids whose crc32 is even lose their line ends."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(load(spark, sf_dir, "documents"), without_line_ends)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _oracle() -> str:
    """Trees and walks as recursive relations."""
    def value(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text):
        return "sha256(" + " || ".join([value(c) for c in FIELDS[:-1]] + [value(text)]) + ")"

    def climb(name, base):
        return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 3, n)"""

    def walk(name, base):
        return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT w.doc, s.tree, s.lvl + 1, s.idx // 3, sha256(s.before || w.acc || s.after), w.proof || s.before || s.after
  FROM {name} w JOIN steps s ON w.tree = s.tree AND w.lvl = s.lvl AND w.idx = s.idx)"""

    return f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM crc WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS l FROM crc WHERE k = 8),
tampering AS (
  SELECT d.*, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents d, crc_table),
leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {leaf("text")} AS hash, {leaf("other")} AS changed
  FROM tampering),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER () AS doc FROM leaf),
{climb("low", "SELECT tree, 0 AS lvl, idx, n, hash FROM placed")},
subroots AS (SELECT tree AS of, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{climb("high", "SELECT '' AS tree, 0 AS lvl, idx, n, hash FROM subroots")},
runs AS (
  SELECT tree, lvl, idx // 3 AS up, list(hash ORDER BY idx) AS hs
  FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY ALL),
steps AS MATERIALIZED (
  SELECT tree, lvl, up * 3 + i AS idx, array_to_string(hs[1:i], '') AS before, array_to_string(hs[i + 2:], '') AS after
  FROM (SELECT *, unnest(range(len(hs))) AS i FROM runs)),
{walk("first", "SELECT doc, tree, 0 AS lvl, idx, changed AS acc, '' AS proof FROM placed")},
tops AS (SELECT tree, lvl AS height, hash AS subroot FROM low WHERE n = 1),
{walk("second", '''SELECT w.doc, '' AS tree, 0 AS lvl, s.idx, w.acc, w.proof
  FROM first w JOIN tops t ON w.tree = t.tree AND w.lvl = t.height JOIN subroots s ON s.of = t.tree''')},
root AS (SELECT lvl AS height, hash AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.hash AS leaf, t.subroot, r.root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.root AS verified
FROM second w JOIN root r ON w.lvl = r.height JOIN placed p ON p.doc = w.doc JOIN tops t ON t.tree = p.tree
"""


ORACLE = _oracle()
