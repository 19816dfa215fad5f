"""Quality classifier: random-indexing word vectors and a small network.

Words hash into BUCKETS rows.  Each row has a fixed sparse ternary index vector;
a row's context vector sums the index vectors of the words around its
occurrences (random indexing), so words used alike get vectors alike.  Beside
the word itself its shape (first sign, length, capitals, last sign) is a second word
with vectors of its own.  A document pools the unit vectors of its words and of
their shapes: means, the norms of the means, and the mean cosine of words one
and two apart, which tells repetition.

A two-layer network (numpy, trained on the driver) turns the pooled vector into
a logit; a temperature fitted on rows left out of training calibrates it.

Vectors and network are fitted on a bounded sample: the FIT_ROWS labelled rows
of smallest hash.  Scoring reads every whole text.  Null and empty texts pool to zeros
and are scored as such.  A doc_id with several labels is used with each.
Without labelled rows every score is 0.5.  Rows are independent, extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import byte_table, load, share, shared_value, span_hashes, text_blocks, words_of
from adlytics.llm.op10_language_id import fold

BUCKETS = 1 << 15
DIM = 48
WINDOW = 2
HIDDEN = 32
FIT_ROWS = 12_000
THRESHOLD = 0.3
SHAPE_SEED = 97


def index_vectors(seed: int = 11, nonzero: int = 6) -> np.ndarray:
    """(2 * BUCKETS, DIM) sparse ternary: words, then shapes."""
    rng = np.random.default_rng(seed)
    out = np.zeros((2 * BUCKETS, DIM), np.int8)
    at = rng.integers(0, DIM, (2 * BUCKETS, nonzero))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return out


def byte_kinds() -> np.ndarray:
    """Lower case, capital, digit and non-ASCII byte by kind; other signs as themselves."""
    kind = np.arange(256, dtype=np.uint64)
    for a, b, k in ((0x61, 0x7A, 0x61), (0x41, 0x5A, 0x41), (0x30, 0x39, 0x30), (0x80, 0xFF, 0x80)):
        kind[a:b + 1] = k
    return kind


@dataclass
class Words:
    """Bucket rows of a block's words and shapes, with their text."""
    word: np.ndarray
    shape: np.ndarray
    text: np.ndarray


def bucket_rows(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    starts, ends = words_of(data, offsets)
    word = (span_hashes(data, starts, ends, table) % np.uint64(BUCKETS)).astype(np.int64)
    kind = byte_kinds()
    capital = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    n_capital = capital[ends] - capital[starts]
    size = ends - starts
    shape = np.zeros(len(starts), np.uint64)
    if len(starts):
        before_last = np.maximum(ends - 2, starts)
        parts = (kind[data[starts]], kind[data[before_last]], kind[data[ends - 1]],
                 np.minimum(size, 12).astype(np.uint64),
                 np.where(n_capital == 0, 0, np.where(n_capital == 1, 1, 2)).astype(np.uint64))
        for p in parts:
            shape = (shape + p + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            shape ^= shape >> np.uint64(31)
    shape = BUCKETS + (shape % np.uint64(BUCKETS)).astype(np.int64)
    return Words(word, shape, np.searchsorted(offsets, starts, side="right") - 1)


def context_sums(batches, table: np.ndarray, index: np.ndarray):
    """One row per bucket seen in the task: bucket, summed context vector."""
    total = np.zeros((2 * BUCKETS, DIM), np.int64)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch):
            w = bucket_rows(data, offsets, table)
            for rows in (w.word, w.shape):
                for step in range(1, WINDOW + 1):
                    a, b = rows[:-step], rows[step:]
                    same = w.text[:-step] == w.text[step:]
                    np.add.at(total, a[same], index[b[same]])
                    np.add.at(total, b[same], index[a[same]])
    seen = np.flatnonzero(total.any(axis=1))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(total[seen].ravel()), DIM).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(seen), vectors], names=["bucket", "vector"])


def unit_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Direction of a bucket: its own index vector plus its damped contexts."""
    size = np.linalg.norm(context, axis=1, keepdims=True)
    own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    v = own + context / np.maximum(size, 1e-9)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIM + 6): means of word and shape vectors, norms of the means,
    mean cosines of words one and two apart."""
    w = bucket_rows(data, offsets, table)
    n_text = len(offsets) - 1
    n = np.bincount(w.text, minlength=n_text)
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n)])[some].astype(np.int64)
    parts = []
    for rows in (w.word, w.shape):
        mean = np.zeros((n_text, DIM), np.float32)
        if len(some):
            mean[some] = np.add.reduceat(vectors[rows], first, axis=0) / n[some][:, None]
        parts += [mean, np.linalg.norm(mean, axis=1, keepdims=True)]
        for step in (1, 2):
            same = w.text[:-step] == w.text[step:]
            alike = np.einsum("ij,ij->i", vectors[rows[:-step][same]], vectors[rows[step:][same]])
            total = np.bincount(w.text[:-step][same], weights=alike, minlength=n_text)
            parts.append((total / np.maximum(n - step, 1)).astype(np.float32)[:, None])
    return np.concatenate(parts, axis=1).astype(np.float32)


@dataclass
class Network:
    """logit = relu((x - mean) / scale @ a + b) @ c + d, divided by the temperature."""
    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.a + self.b, 0) @ self.c + self.d

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3,
                  decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on mini-batches; one row in five is left out for the temperature."""
    rng = np.random.default_rng(seed)
    left_out = rng.permutation(len(x)) % 5 == 0
    fx, fy = x[~left_out].astype(np.float64), y[~left_out].astype(np.float64)
    if not len(fx):
        fx, fy = x.astype(np.float64), y.astype(np.float64)
    mean, scale = fx.mean(0), fx.std(0) + 1e-3
    fx = (fx - mean) / scale
    d_in = fx.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d_in), (d_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(fx))
        for s in range(0, len(fx), batch):
            i = order[s:s + batch]
            h = fx[i] @ p[0] + p[1]
            r = np.maximum(h, 0)
            g = (1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -30, 30))) - fy[i]) / len(i)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [fx[i].T @ back + decay * p[0], back.sum(0), r.T @ g + decay * p[2], g.sum(keepdims=True)]
            t += 1
            for k, q in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(mean, scale, *p)
    if left_out.any():
        z, cy = net.logits(x[left_out].astype(np.float64)), y[left_out]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
        loss = [np.mean(np.logaddexp(0, z / k) - cy * z / k) for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """(table, vectors, network or None) from docs (doc_id, text) and labels (doc_id, label 0/1)."""
    spark = docs.sparkSession
    table, index = byte_table(SHAPE_SEED), index_vectors()
    chosen = (labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
              .orderBy(F.xxhash64(F.lit("quality"), "doc_id", "label"), "doc_id").limit(fit_rows))
    # at most fit_rows rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").cache()
    fixed = spark.sparkContext.broadcast((table, index))
    sums = (sample.select("text").mapInArrow(lambda b: context_sums(b, *fixed.value), "bucket long, vector array<long>")
            .groupBy("bucket").agg(F.array(*[F.sum(F.col("vector")[i]) for i in range(DIM)]).alias("vector")).toArrow())
    context = np.zeros((2 * BUCKETS, DIM))
    if sums.num_rows:
        flat = sums["vector"].combine_chunks().flatten().to_numpy()
        context[sums["bucket"].to_numpy()] = flat.reshape(-1, DIM)
    vectors = unit_vectors(context, index)
    shared = spark.sparkContext.broadcast((table, vectors))
    got = _pool(sample, shared, ("doc_id", "label")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    sample.unpersist()
    if not got.num_rows:
        return table, vectors, None
    x = got["pooled"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return table, vectors, train_network(x, got["label"].to_numpy().astype(np.float64))


def _pool(rows: DataFrame, shared, keep) -> DataFrame:
    def step(batches):
        table, vectors = shared.value
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                x = pooled(data, offsets, table, vectors)
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in keep]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(kept + [lists], names=[*keep, "pooled"])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["pooled array<float>"])
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(step, schema)


def score(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and score in [0, 1]: how likely label 1 is."""
    shared = share(docs.sparkSession, model)

    def step(batches):
        table, vectors, network = shared_value(shared)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                x = pooled(data, offsets, table, vectors)
                p = network.probability(x) if network is not None else np.full(len(x), 0.5)
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(p.astype(np.float64))], names=[*keep, "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(step, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = (load(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
              .select("doc_id", F.col("quality").cast("int").alias("label")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
