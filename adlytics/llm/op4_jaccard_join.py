"""Exact n-gram Jaccard join with PartEnum signatures.

Sets of word shingles link when |A n B| / |A u B| >= threshold.  Equal sets
form one class; classes are compared.  Sizes fall into bands; a pair belongs to the band
of its larger set, so a set joins its own band and the next one if a partner
there can still be similar.  In a band with largest size hi, linked sets differ in
at most k = floor(2 hi (1 - t) / (1 + t)) features.

PartEnum: the feature domain is cut into n1 partitions and each of those into
n2 cells.  Of n1 = floor(k/2) + 1 + spare partitions at least 1 + spare hold at most
one differing feature, hence at most one differing cell, so that the set of
some n2 - 1 cells is the same for both.  Each such subset of cells gives a signature;
linked sets share one.

The spare partitions allow signatures that say little to be left out: subsets of
fewer than LIGHT features, and signatures that more than HOT classes share (a
passage that many documents hold).  A set with light subsets in no more than a
quarter of ``spare`` partitions drops them, else it keeps them all and that quarter
is lost.  It drops shared signatures if it meets them in no more than the rest of the
spare partitions.  Both sets of a pair see the same subset and the same bucket: light
and shared ones that either drops fill at most ``spare`` of the partitions with a
common subset, so a linked pair keeps a common signature.

A pair needs its shared signatures only if both its sets keep some.  With ``Rule.again`` such
sets get signatures of a second kind instead: fewer partitions with more cells, of which
a subset leaves ``leave`` out, so that a signature says more.  (Of floor(k/(leave + 1)) + 1 +
spare partitions at least 1 + spare hold at most ``leave`` differing features.)  A rule of many
subsets has many signatures: SUBSETS of a partition's are made, shuffled and reduced to the shared
ones at a time, so that the disk holds no more of them than of a rule with as few.

Classes that keep shared signatures to the end meet by their rarest features instead: of
as many of them as similar sets cannot all differ in, linked sets share one.  How often a
feature comes is counted among these classes alone; one that a single class has finds nothing
and is not shuffled again.

* Buckets of at most HOT classes give their pairs (28 a bucket at most).  A
  sketch, the counts of features by cell of a coarse partition, bounds the
  difference from below and rules most false pairs out.  Its cells grow with the set, or it
  would rule out no pair of long texts; that of a pair's longer set is folded to the shorter's.
* The pairs left and the larger buckets of rarest features give families: components of
  candidates.  A family is compared in blocks of at most about BLOCK features: within a
  block, or a pair of blocks, sets are candidates if they share one of their rarest
  features (as many as similar sets cannot all differ in), and candidates not
  yet in one component are verified.  No block pair returns more rows than it has sets.

Shingles are 64-bit, classes 60-bit hashes.  Null texts and texts without words have
an empty set and link with nothing.  Repeated rows share a class.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.llm.common import byte_table, checkpoint, forget, load, mix64, span_hashes, text_blocks, words_of, written
from adlytics.llm.components import components

LIGHT = 3
LIGHT_PART = 4            # one in so many spare partitions is for light subsets
HOT = 8
BAND_RATIO = 1.5
SKETCH = 128              # least cells of a sketch, one byte each
CELL_FEATURES = 8         # features a cell, beyond which a sketch has twice the cells
MOST_CELLS = 1 << 16
SUBSETS = 3               # subsets of a partition whose signatures are shuffled at once
BLOCK = 750_000           # features of a family's block
MAX_BROADCAST = 500_000   # rows of one or two longs
WORD_SEED = 41


@dataclass(frozen=True)
class Rule:
    """Words per shingle, the threshold num/den, cells per partition, the
    share of spare partitions in percent, the cells that a subset leaves out, and the
    rule of the second signatures, for sets that keep shared ones (None: no second)."""
    words: int = 3
    num: int = 9
    den: int = 10
    cells: int = 3
    spare: int = 20
    leave: int = 1
    again: "Rule | None" = None


def set_blocks(batch: pa.RecordBatch, words: int, table: np.ndarray):
    """Yield (first, last, sets): per text the sorted array of its shingle hashes."""
    for first, last, data, offsets in text_blocks(batch):
        upper = (data >= 0x41) & (data <= 0x5A)
        data = np.where(upper, data + np.uint8(32), data)
        starts, ends = words_of(data, offsets)
        h = span_hashes(data, starts, ends, table)
        at = np.searchsorted(starts, offsets)  # words of each text
        n = len(h)
        roll = np.zeros(max(n - words + 1, 0), np.uint64)
        for j in range(words):
            roll = mix64(roll * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(roll)])
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                sets.append(np.unique(roll[a:b - words + 1]))
            elif b > a:  # the whole sequence as one
                x = np.zeros(1, np.uint64) + np.uint64(b - a)
                for j in range(a, b):
                    x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[j:j + 1])
                sets.append(x)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, last, sets


def class_of(s: np.ndarray) -> np.ndarray:
    """60-bit hash of a set, whatever its order."""
    return mix64(mix64(s + np.uint64(77)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0] >> np.uint64(4)


def band_edges() -> np.ndarray:
    """Smallest size of each band; 63 bands reach beyond any text."""
    out = [1]
    while len(out) < 64:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return np.array(out, np.int64)


def layout(edges: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By band: largest difference k, partitions n1, spare partitions among them."""
    hi = edges[1:] - 1
    k = 2 * hi * (rule.den - rule.num) // (rule.den + rule.num)
    base = k // (rule.leave + 1) + 1
    spare = np.where(base >= 5, -(-base * rule.spare // 100), 0)
    return k, np.where(k == 0, 1, base + spare), spare


def sketch(s: np.ndarray) -> bytes:
    """Features by cell of a coarse partition, up to 255 in a cell; SKETCH cells or,
    for larger sets, a power of two times as many."""
    cells = SKETCH
    while cells * CELL_FEATURES < len(s) and cells < MOST_CELLS:
        cells *= 2
    cell = (mix64(s + np.uint64(5)) % np.uint64(cells)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=cells), 255).astype(np.uint8).tobytes()


def sketches_apart(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """For each pair of sketches a lower bound of the features in which its sets differ."""
    apart = np.zeros(len(one), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(one, two)], np.int64).reshape(-1, 2)
    for a, b in np.unique(sizes, axis=0).tolist():
        cells, rows = min(a, b), np.flatnonzero((sizes == [a, b]).all(axis=1))
        for at in np.array_split(rows, -(-len(rows) * max(a, b) // (1 << 22))):
            x, y = (np.frombuffer(b"".join([side[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, cells).sum(axis=1, dtype=np.int32)
                    for side in (one, two))
            apart[at] = np.abs(x - y).sum(axis=1)
    return apart


def turns(rule: Rule) -> int:
    """Into how many turns the subsets of a partition are dealt."""
    return -(-comb(rule.cells, rule.leave) // SUBSETS)


def signatures(sets: list[np.ndarray], rule: Rule, edges: np.ndarray, turn: int = 0, of_turns: int = 1):
    """(key, index of the set, fifteenths) of the subsets dealt to one of the turns.
    A key has, from the high bits, 45 of the subset's hash, 6 of the band and 13 of the
    partition.  The fifteenths tell how many of its band's spare partitions the set may
    still do without (rounded down; none if the partitions do not fit their bits)."""
    size = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(edges, size, side="right") - 1
    top = np.searchsorted(edges, size * rule.den // rule.num, side="right") - 1
    some = np.flatnonzero(size)
    extra = some[top[some] > own[some]]
    inst_set = np.concatenate([some, extra])
    band = np.concatenate([own[some], own[extra] + 1])
    if not len(inst_set):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n1, spare = (x[band] for x in layout(edges, rule))
    m = rule.cells
    start = np.concatenate([[0], np.cumsum(n1 * m)])
    n_feat = size[inst_set]
    features = np.concatenate([sets[i] for i in inst_set.tolist()])
    inst = np.repeat(np.arange(len(inst_set)), n_feat)
    place = mix64(features + np.uint64(1001))
    part = ((place >> np.uint64(32)) % n1[inst].astype(np.uint64)).astype(np.int64)
    cell = ((place & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
    at = start[inst] + part * m + cell
    sums = np.zeros(start[-1], np.uint64)
    np.add.at(sums, at, mix64(features + np.uint64(1002)))
    count = np.bincount(at, minlength=start[-1]).reshape(-1, m)
    sums = sums.reshape(-1, m)
    # a subset leaves some cells out
    out = np.array(list(combinations(range(m), rule.leave)), np.int64)
    mine = np.arange(turn, len(out), of_turns)
    sub_sum = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums[:, out[mine]].sum(axis=2, dtype=np.uint64)
    sub_count = count.sum(axis=1, keepdims=True) - count[:, out].sum(axis=2)
    row_inst = np.repeat(np.arange(len(inst_set)), n1)
    row_part = np.arange(len(row_inst)) - np.repeat(start[:-1] // m, n1)
    light = sub_count < LIGHT
    n_light = np.bincount(row_inst, weights=light.any(axis=1), minlength=len(inst_set)).astype(np.int64)
    most = spare // LIGHT_PART
    drop = (light & (n_light <= most)[row_inst][:, None])[:, mine]
    left = spare - np.minimum(n_light, most)  # a partner may drop up to ``most`` that this set keeps
    zero_k = (k == 0)[row_inst]
    name = (band[row_inst] << 32) + row_part
    sig = mix64(sub_sum + mix64((name[:, None] * 256 + mine[None, :]).astype(np.uint64)) + sub_count[:, mine].astype(np.uint64))
    row, col = np.nonzero(~drop & ~zero_k[:, None])
    whole = np.flatnonzero(zero_k if turn == 0 else [])  # linked sets are equal: one signature, of the whole set
    whole_sig = mix64(sums[whole].sum(axis=1, dtype=np.uint64) + mix64((name[whole] * 256 + 255).astype(np.uint64)))
    row = np.concatenate([row, whole])
    sig = np.concatenate([sig[row[:len(col)], col], whole_sig])
    of = row_inst[row]
    fifteenths = np.where((spare > 0) & (n1 <= 1 << 13), 15 * left // np.maximum(spare, 1), 0)[of]
    low = (band[of] << 13) | (row_part[row] & 0x1FFF)
    return (sig & ~np.uint64(0x7FFFF)) | low.astype(np.uint64), inst_set[of], fifteenths


def class_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, h (hash of the text), n, class (null for an empty set), sketch."""
    def step(batches):
        table = byte_table(WORD_SEED)
        for batch in batches:
            for first, last, sets in set_blocks(batch, rule.words, table):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(class_of(s)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "h", "n", "class", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(
        step, "doc_id long, h long, n long, class long, sketch binary")


def signature_rows(docs: DataFrame, rule: Rule, turn: int, of_turns: int) -> DataFrame:
    """key, tagged (class and fifteenths): each class once per task that meets it;
    the signatures of one of the turns."""
    def step(batches):
        table, edges, met = byte_table(WORD_SEED), band_edges(), set()
        for batch in batches:
            for _, _, sets in set_blocks(batch, rule.words, table):
                fresh, classes = [], []
                for s in sets:
                    if len(s):
                        c = int(class_of(s))
                        if c not in met:  # equal sets add nothing; the memory is bounded
                            if len(met) >= 1_000_000:
                                met.clear()
                            met.add(c)
                            fresh.append(s)
                            classes.append(c)
                key, of, fifteenths = signatures(fresh, rule, edges, turn, of_turns)
                tagged = (np.array(classes, np.int64)[of] << 4) | fifteenths
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tagged)], names=["key", "tagged"])

    return docs.select("text").mapInArrow(step, "key long, tagged long")


def shared_rows(rows: DataFrame) -> DataFrame:
    """key, tagged, hot: the signatures that several classes have."""
    by_key = Window.partitionBy("key")
    rows = rows.repartition("key")  # two longs a row; all else is derived behind the shuffle
    return (rows.withColumn("lo", F.min("tagged").over(by_key)).withColumn("hi", F.max("tagged").over(by_key))
            .filter("lo < hi").select("key", "tagged").distinct()
            .withColumn("hot", F.count("*").over(by_key) > HOT))


def kept_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, class, hot: the shared signatures that the classes keep."""
    n = turns(rule)
    if n == 1:
        rows = shared_rows(signature_rows(docs, rule, 0, 1))
    else:  # the docs are read each turn, and a turn's shuffle goes before the next
        parts = []
        for turn in range(n):
            parts.append(written(shared_rows(signature_rows(docs, rule, turn, n))))
            forget(docs.sparkSession)
        rows = reduce(DataFrame.unionByName, parts)
    # the keys of a class come together, as many as its text is long
    band = F.shiftright("key", 13).bitwiseAND(63)
    sets = rows.withColumn("band", band).groupBy("tagged", "band").agg(
        F.collect_list(F.when(F.col("hot"), F.col("key"))).alias("hots"), F.collect_list(F.when(~F.col("hot"), F.col("key"))).alias("cold"))
    met = F.size(F.array_distinct(F.transform("hots", lambda x: x.bitwiseAND(0x1FFF))))
    spare = F.element_at(F.array(*[F.lit(int(x)) for x in layout(band_edges(), rule)[2]]), (F.col("band") + 1).cast("int"))
    left = F.floor(F.col("tagged").bitwiseAND(15) * spare / 15)

    def flagged(name: str, hot: bool):
        return F.transform(name, lambda x: F.struct(x.alias("key"), F.lit(hot).alias("hot")))

    keys = F.when(met > left, F.concat(flagged("cold", False), flagged("hots", True))).otherwise(flagged("cold", False))
    return written(sets.select(F.shiftrightunsigned("tagged", 4).alias("class"), F.explode(keys).alias("x")).select("x.key", "class", "x.hot"))


def rarest_rows(texts: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """key (a feature), class, hot: the features that come with several of the classes among
    their rarest, of which linked sets share one.  ``texts``: class, text, a row per class;
    ``sizes``: class, n."""
    by_key = Window.partitionBy("key")
    rows = feature_rows(texts, rule).repartition("key").withColumn("often", F.count("*").over(by_key)).filter("often > 1")
    sets = rows.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("l")).join(sizes.select("class", "n"), "class")
    # the features of this class alone are its rarest, and left out above
    many = F.greatest(F.size("l") + 1 - F.expr(f"(n * {rule.num} + {rule.den - 1}) div {rule.den}"), F.lit(0)).cast("int")
    rows = sets.select("class", F.explode(F.slice("l", 1, many)).alias("x")).select("x.key", "class")
    rows = rows.repartition("key").withColumn("often", F.count("*").over(by_key)).filter("often > 1")
    return written(rows.select("key", "class", (F.col("often") > HOT).alias("hot")))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def bucket_pairs(kept: DataFrame) -> DataFrame:
    """(a, b) classes that share a signature few classes have."""
    lists = kept.filter("not hot").groupBy("key").agg(F.collect_set("class").alias("l"))
    pairs = lists.select(F.explode("l").alias("a"), "l").select("a", F.explode(F.filter("l", lambda x: x > F.col("a"))).alias("b"))
    return pairs.distinct()


def near_sketches(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    def step(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            apart = sketches_apart(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            ok = (np.minimum(na, nb) * rule.den >= np.maximum(na, nb) * rule.num) & (
                apart <= (na + nb) * (rule.den - rule.num) // (rule.den + rule.num))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    one = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return checkpoint(pairs.join(one, "a").join(two, "b").mapInArrow(step, "a long, b long"))


# ------------------------------------------------------------------- families

def link_block(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, rule: Rule) -> np.ndarray:
    """A forest of links within ``sets_a`` (``sets_b`` None) or between the two
    lists: (links, 2) positions in their concatenation."""
    sets = sets_a + (sets_b or [])
    n, first = len(sets), len(sets_a)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    # features numbered; then each set's from the rarest on: similar sets share one of the first
    every = np.concatenate(sets)
    order = np.argsort(every)
    every = every[order]
    number = np.zeros(len(every), np.int32)
    np.cumsum(every[1:] != every[:-1], out=number[1:])
    ids = np.empty(len(every), np.int32)
    ids[order] = number
    del every, order, number
    often = np.bincount(ids).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    if n < 1 << 20 and len(often) < 1 << 23:  # set, frequency and number in one word to sort
        key = (doc.astype(np.int64) << 43) | (np.minimum(often, (1 << 20) - 1)[ids].astype(np.int64) << 23) | ids
        key.sort()
        ids = (key & ((1 << 23) - 1)).astype(np.int32)
        del key
    else:
        ids = ids[np.lexsort((ids, often[ids], doc))]
    depth = size - -(-size * rule.num // rule.den) + 1
    early = (np.arange(len(ids)) - start[doc] < depth[doc]) & (often[ids] > 1)
    listed = doc < first if sets_b is not None else np.ones(len(doc), bool)
    by_feature = np.flatnonzero(early & listed)
    by_feature = by_feature[np.argsort(ids[by_feature], kind="stable")]
    post_doc, post_start = doc[by_feature], np.searchsorted(ids[by_feature], np.arange(len(often) + 1))
    mark = np.zeros(len(often), bool)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for d in range(first if sets_b is not None else 1, n):
        mine = ids[start[d]:start[d + 1]]
        found = [post_doc[post_start[f]:post_start[f + 1]] for f in mine[:depth[d]] if post_start[f] < post_start[f + 1]]
        if not found:
            continue
        c = np.unique(np.concatenate(found))
        c = c[c < d]
        c = c[np.minimum(size[c], size[d]) * rule.den >= np.maximum(size[c], size[d]) * rule.num]
        mark[mine] = True
        while len(c):
            # some at a time, since a link makes more of its component needless
            some, c = c[:64], c[64:]
            spans = [ids[start[x]:start[x + 1]] for x in some.tolist()]
            shared = np.add.reduceat(mark[np.concatenate(spans)], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
            for x in some[shared * rule.den >= (size[some] + size[d] - shared) * rule.num].tolist():
                if root(x) != root(d):
                    parent[root(x)] = root(d)
                    links.append((x, d))
            if len(c) and links and links[-1][1] == d:
                c = c[np.array([root(x) for x in c.tolist()]) != root(d)]
        mark[mine] = False
    return np.array(links, np.int64).reshape(-1, 2)


def family_links(sets: DataFrame, family: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): verified links that connect what is connected within each family.
    ``family``: class, family, n (the size of the class's set)."""
    blocks = checkpoint(family.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")))
    place = checkpoint(family.join(blocks, "family").select(
        "class", "family", "n", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"), "blocks"))
    members = sets.join(small(place), "class")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        sizes = f["n"].to_numpy("<i8")
        return pd.DataFrame({"family": [f["family"].iloc[0]], "block": [f["block"].iloc[0]], "blocks": [f["blocks"].iloc[0]],
                             "classes": [f["class"].to_numpy("<i8").tobytes()],
                             "sizes": [sizes.tobytes()], "features": [b"".join(np.asarray(x, "<i8").tobytes() for x in f["shingles"])]})

    packed = written(members.select("family", "block", "class", "n", "shingles", "blocks").groupBy("family", "block").applyInPandas(
        pack, "family long, block long, blocks long, classes binary, sizes binary, features binary"))
    forget(sets.sparkSession)
    several = packed.filter("blocks > 1")
    other = several.select("family", F.col("block").alias("block2"), F.col("classes").alias("classes2"),
                          F.col("sizes").alias("sizes2"), F.col("features").alias("features2"))
    # a block with itself needs no second copy
    alone = packed.withColumns({"classes2": F.lit(None).cast("binary"), "sizes2": F.lit(None).cast("binary"), "features2": F.lit(None).cast("binary")})
    columns = ["classes", "sizes", "features", "classes2", "sizes2", "features2"]
    jobs = alone.select(*columns).unionByName(several.join(other, "family").filter("block < block2").select(*columns))

    def unpack(sizes, features):
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        features = np.frombuffer(features, "<u8")
        return [features[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                classes, sizes, features, classes2, sizes2, features2 = (batch.column(c)[i].as_py() for c in columns)
                names = np.frombuffer(classes + (classes2 or b""), "<i8")
                links = link_block(unpack(sizes, features), unpack(sizes2, features2) if classes2 is not None else None, rule)
                yield pa.RecordBatch.from_arrays([pa.array(names[links[:, 0]]), pa.array(names[links[:, 1]])], names=["a", "b"])

    return jobs.mapInArrow(step, "a long, b long")


def class_texts(docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """class, text: one text of each of ``classes`` (class, doc_id, h).  ``repeated``:
    rows of docs repeat, so that a class may meet its text more than once."""
    chosen = small(classes.select("class", F.col("doc_id").alias("_id"), F.col("h").alias("_h")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    texts = texts.join(chosen, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "text")
    return texts.dropDuplicates(["class"]) if repeated else texts


def class_links(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) links between classes that connect every component."""
    kept = kept_rows(docs, rule)
    forget(docs.sparkSession)
    whole = checkpoint(classes.filter("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    where = whole.select("class", "row.doc_id", "row.h", "n")
    repeated = not classes.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()
    pairs = near_sketches(bucket_pairs(kept), whole, rule)
    if rule.again is not None:
        hard = checkpoint(kept.filter("hot").select("class").distinct().join(where, "class"))
        kept = kept_rows(written(class_texts(docs, hard, repeated)), rule.again)
        forget(docs.sparkSession)
        pairs = pairs.unionByName(near_sketches(bucket_pairs(kept), whole, rule))
    hard = checkpoint(kept.filter("hot").select("class").distinct().join(where, "class"))
    kept = rarest_rows(class_texts(docs, hard, repeated), hard, rule)
    forget(docs.sparkSession)
    pairs = pairs.unionByName(near_sketches(bucket_pairs(kept), whole, rule))
    hot = kept.filter("hot").select("class", F.min("class").over(Window.partitionBy("key")).alias("rep")).filter("class <> rep").distinct()
    candidates = hot.select(F.col("rep").alias("a"), F.col("class").alias("b")).unionByName(pairs)
    family = components(candidates).select(F.col("node").alias("class"), F.col("label").alias("family"))
    family = checkpoint(family.join(where, "class"))
    sets = shingle_sets(class_texts(docs, family, repeated), rule)
    forget(docs.sparkSession)
    links = family_links(sets, family.select("class", "family", "n"), rule)
    # a row holds one or two blocks: do not gather many of them in a batch
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 20))
    try:
        return checkpoint(links)
    finally:
        spark.conf.set(name, before)


def labelled(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The rows of class_rows; and class, label (of its component), least doc_id
    of the class."""
    classes = checkpoint(class_rows(docs, rule))
    labels = components(class_links(docs, classes, rule)).withColumnRenamed("node", "class")
    first = classes.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    return classes, checkpoint(first.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))


def jaccard_join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id per document row."""
    classes, named = labelled(docs, rule)
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    out = classes.select("doc_id", "n", "class").join(named.join(least, "label").select("class", "least"), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row of each component: that of its smallest doc_id (null after
    every id), the first text in order if the id repeats.  Rows without words link
    with nothing and stay, once per equal row."""
    classes, named = labelled(docs, rule)
    named = named.select("class", "label")
    keys = checkpoint(classes.filter("class is not null").select("doc_id", "h", "class").distinct().join(named, "class").select("doc_id", "h", "label"))
    # aggregates skip nulls: the least is null only where no row has an id
    least = keys.groupBy("label").agg(F.min("doc_id").alias("least"))
    top = keys.join(least, "label").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    best = checkpoint(top.groupBy("label").agg(F.min("least").alias("least"), F.min("h").alias("best"), F.max("h").alias("other")))
    here = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})

    def meets(keys: DataFrame):
        return (F.col("_h") == keys["h"]) & F.col("_id").eqNullSafe(keys["doc_id"])

    ties = best.filter("best <> other").select("label")
    if not ties.isEmpty():  # an id with several texts of a component
        tied = small(checkpoint(top.join(ties, "label").select("doc_id", "h", "label")))
        texts = here.select("_id", "_h", "text").join(tied, meets(tied)).groupBy("label").agg(F.min("text").alias("text"))
        texts = texts.select("label", F.xxhash64("text").alias("first"))
        best = checkpoint(best.join(texts, "label", "left").select("label", "least", F.coalesce("first", "best").alias("best")))
    gone = keys.join(best, "label").filter((F.col("h") != F.col("best")) | ~F.col("doc_id").eqNullSafe(F.col("least")))
    gone = small(checkpoint(gone.select("doc_id", "h")))
    kept = here.join(gone, meets(gone), "left_anti")
    again = checkpoint(classes.groupBy("doc_id", "h").agg(F.count("*").alias("rows"), F.max("n").alias("n")).filter("rows > 1"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    every = small(again.select("doc_id", "h"))
    alone = kept.join(every, meets(every), "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    some = small(again.filter("n > 0").select("doc_id", "h"))
    first = (kept.join(some, meets(some), "left_semi").groupBy("_id", "_h")
             .agg(F.min(F.struct("text", "doc_id", *rest)).alias("_row")))
    first = first.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    blank = small(again.filter("n = 0").select("doc_id", "h"))
    empty = kept.join(blank, meets(blank), "left_semi").select(*docs.columns).distinct()
    return alone.unionByName(first).unionByName(empty)


def shingle_sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """class, shingles: a row per class (should hashes of texts clash, only the
    text of the class counts)."""
    def step(batches):
        table = byte_table(WORD_SEED)
        for batch in batches:
            for first, last, sets in set_blocks(batch, rule.words, table):
                want = batch.column("class").slice(first, last - first).to_pylist()
                ok = [i for i, s in enumerate(sets) if len(s) and int(class_of(s)) == want[i]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([want[i] for i in ok], pa.int64()),
                    pa.array([sets[i].view(np.int64) for i in ok], pa.list_(pa.int64()))], names=["class", "shingles"])

    return texts.select("class", "text").mapInArrow(step, "class long, shingles array<long>")


def feature_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """key, class: a row per shingle of each class (texts as in ``shingle_sets``)."""
    def step(batches):
        table = byte_table(WORD_SEED)
        for batch in batches:
            for first, last, sets in set_blocks(batch, rule.words, table):
                want = batch.column("class").slice(first, last - first).to_pylist()
                ok = [i for i, s in enumerate(sets) if len(s) and int(class_of(s)) == want[i]]
                if ok:
                    key = np.concatenate([sets[i] for i in ok]).view(np.int64)
                    of = np.repeat(np.array([want[i] for i in ok], np.int64), [len(sets[i]) for i in ok])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of)], names=["key", "class"])

    return texts.select("class", "text").mapInArrow(step, "key long, class long")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))
