"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes (64-bit, each step shifts left and adds a
random number of the byte, so 64 bytes count).  Chunks end where it has zero
bits under a mask: a strict mask up to NORMAL bytes after the chunk's start, a
loose one from there on, at MAXIMUM at the latest (normalised chunking), so an
insertion moves the borders only near it.  A fingerprint is the sorted set of
64-bit words (digest of the chunk, its length in the low byte), as base64.
The likeness of two fingerprints is the shared length over the smaller total
length: 1 if one text contains the other's chunks.

All of a block's texts are cut together: the next border after every position
is an array, and all texts follow it in step.

``edited_pairs`` lays the documents out in descending doc_id order to edit each
with its successor.  Buckets of neighbouring ids come from approximate quantiles
(one per shuffle partition and some more, so their number is the cluster's, not the
data's); the first row of each bucket is also sent to the bucket before it.
Nothing is ordered in one task.

A null text is empty.  Two empty texts are alike (1), an empty and a non-empty
one are not (0).  Equal doc_ids follow each other in the order of their texts,
null doc_ids come last; a table of one row is followed by itself.  Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import BLOCK_BYTES, byte_table, load, mix64, shuffle_width, text_bytes

MINIMUM, NORMAL, MAXIMUM = 8, 24, 96   # a length fits the low byte of a word
STRICT, LOOSE = 6, 4                   # mask bits: one border in 64 or in 16 bytes
GEAR_SEED = 2024


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash at every byte, by doubling the number of bytes summed."""
    h = table[data]
    step = 1
    while step < 64:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint64(step)
        h, step = longer, step * 2
    return h


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Chunk starts of all texts, ascending."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # bytes before a text must not change its borders: the masks use the top
    # bits, which the last 64 bytes fill, so hash each text on its own ground
    h = gear_per_text(data, offsets, table)
    place = np.arange(n, dtype=np.int32)
    far = np.int32(n + MAXIMUM)

    def next_after(zero_bits: int) -> np.ndarray:
        at = np.where((h >> np.uint64(64 - zero_bits)) == 0, place + np.int32(1), far)  # border behind the byte
        return np.concatenate([np.minimum.accumulate(at[::-1])[::-1], np.full(MAXIMUM + 1, far, np.int32)])

    strict, loose = next_after(STRICT), next_after(LOOSE)
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    live = begin < end
    cur, end = begin[live], end[live]
    found = []
    while len(cur):
        found.append(cur)
        nxt = strict[cur + MINIMUM - 1].astype(np.int64)
        late = nxt > cur + NORMAL
        if late.any():
            nxt[late] = np.minimum(loose[cur[late] + NORMAL], cur[late] + MAXIMUM)
        cur = nxt
        go = cur < end
        cur, end = cur[go], end[go]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def gear_per_text(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash that starts anew at every text: the first 63 bytes of each text
    take away what came over from the text before."""
    h = gear(data, table)
    starts = offsets[1:-1]
    starts = starts[(starts > 0) & (starts < len(data)) & (np.diff(offsets)[1:] > 0)]
    if len(starts):
        back = np.arange(63)
        carry = h[starts - 1][:, None] << (back + 1).astype(np.uint64)[None, :]
        at = starts[:, None] + back[None, :]
        own_end = offsets[np.searchsorted(offsets, starts, side="right")]
        own = at < own_end[:, None]
        h[at[own]] -= carry[own]
    return h


def chunk_words(data: np.ndarray, offsets: np.ndarray, gears: np.ndarray, digest: np.ndarray):
    """(words, text of each): per chunk a 56-bit digest and the length."""
    starts = cut(data, offsets, gears)
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), offsets[text + 1])
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), text
    place = np.arange(len(data)) - np.repeat(starts, size)
    sums = np.add.reduceat(mix64(digest[data] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    return (mix64(sums + size.astype(np.uint64)) & ~np.uint64(0xFF)) | size.astype(np.uint64), text


def fingerprints(data: np.ndarray, offsets: np.ndarray, gears: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
    """Per text the sorted set of its chunk words."""
    words, text = chunk_words(data, offsets, gears, digest)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    return [np.unique(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared chunk length over the smaller set's length."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    shared = int((np.intersect1d(a, b, assume_unique=True) & np.uint64(0xFF)).sum())
    return shared / min(int((a & np.uint64(0xFF)).sum()), int((b & np.uint64(0xFF)).sum()))


def encode(words: np.ndarray) -> str:
    return base64.b64encode(words.astype("<u8").tobytes()).decode()


def fingerprint_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and the fingerprint of each whole text."""
    gears, digest = byte_table(GEAR_SEED), byte_table(GEAR_SEED + 1)

    def step(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            out = [encode(f) for f in fingerprints(data, offsets, gears, digest)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fingerprint string"])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(step, schema)


# ------------------------------------------------------- documents in id order

def in_order(docs: DataFrame) -> DataFrame:
    """bucket, guest, doc_id, text: partitions sorted by descending doc_id; each
    bucket ends with a guest row, the document that follows its last one."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * shuffle_width(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    # number of borders above the id: equal ids share a bucket, null ids the last one
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(
        F.size(F.filter(edges, lambda c: c > F.col("doc_id")))).cast("int")
    docs = docs.withColumn("bucket", bucket)
    # first document of every bucket: one row per bucket
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return docs.withColumn("guest", F.lit(0)).select("bucket", "guest", "doc_id", "text")
    before = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
    host = F.element_at(F.array(*[F.lit(before.get(b, -1)) for b in range(len(cuts) + 1)]), F.col("bucket") + 1)
    ids = [h["head"] for h in heads if h["head"] is not None]
    first = F.col("doc_id").isNull() | (F.col("doc_id").isin(ids) if ids else F.lit(False))
    guests = (docs.filter(first)
              .groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
              .withColumn("bucket", host).withColumn("guest", F.lit(1)))
    # a null id is a head only if its bucket has no other id
    null_hosts = [before[h["bucket"]] for h in heads if h["head"] is None]
    guests = guests.filter(F.col("doc_id").isNotNull() | F.col("bucket").isin(null_hosts or [-1]))
    rows = docs.withColumn("guest", F.lit(0)).select("bucket", "guest", "doc_id", "text").unionByName(
        guests.select("bucket", "guest", "doc_id", "text"))
    return (rows.repartition(shuffle_width(spark), "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"))


def _pairs(batches):
    """(doc_id, text, next text) in order; a row waits for the one after it."""
    waiting = None
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            if waiting is not None and waiting[1] == 0:
                assert waiting[0] == row[0], "a bucket ends with its guest"
                yield waiting[2], waiting[3], row[3]
            waiting = row


def _edit(pairs):
    gears, digest = byte_table(GEAR_SEED), byte_table(GEAR_SEED + 1)

    def flush(rows):
        ids, texts, nexts = zip(*rows)
        edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, nexts)]
        raw = [e.encode("utf-8", "surrogatepass") for e in edited]
        # the texts of a run follow each other: only the last one's successor is new
        chain = [*texts, nexts[-1]]
        every = [t.encode("utf-8", "surrogatepass") for t in chain] + raw
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in every], dtype=np.int64)])
        f = fingerprints(np.frombuffer(b"".join(every), np.uint8), offsets, gears, digest)
        own, after = f[:len(texts)], f[len(texts) + 1:]
        follow = [f[i + 1] if nexts[i] == chain[i + 1] else None for i in range(len(texts))]
        for i, got in enumerate(follow):
            if got is None:  # the run goes on in another bucket
                b = np.frombuffer(nexts[i].encode("utf-8", "surrogatepass"), np.uint8)
                follow[i] = fingerprints(b, np.array([0, len(b)]), gears, digest)[0]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in raw]),
            pa.array([encode(x) for x in own]), pa.array([encode(x) for x in after]),
            pa.array([likeness(a, b) for a, b in zip(own, after)]),
            pa.array([likeness(a, b) for a, b in zip(own, follow)])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows, held = [], 0
    for pair in pairs:
        rows.append(pair)
        held += len(pair[1])
        if held > BLOCK_BYTES // 2:
            yield flush(rows)
            rows, held = [], 0
    if rows:
        yield flush(rows)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likenesses
    to the edited text and to the next document."""
    return in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        lambda batches: _edit(_pairs(batches)),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(load(spark, sf_dir, "documents"))
