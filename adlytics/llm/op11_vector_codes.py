"""Vector code compression: product-quantiser codes by exact integer arithmetic.

Components become integers floor(scale * x).  Vectors are cut into ``parts`` equal
consecutive parts; each part position has a codebook that starts as that part of the
first ``entries`` vectors by id and is refined in ``rounds`` rounds: every part goes
to its nearest entry, every entry becomes the floored mean of its parts.

Distances are exact.  |x - c|^2 = |x|^2 + |c|^2 - 2 x.c, and the dot products of a
block are matrix products of float64 limbs: integers are broken into limbs so
narrow that no sum of limb products passes 2^53, each pair of limbs is one BLAS call
without rounding, and the products are put together with shifts in int64.  The first
smallest value then names the entry, so ties go to the lower index.  Narrow values need
one limb, wide ones two or three; the result does not depend on the limbs.

Each round is one pass over the vectors.  A task keeps 256 sums a part and returns
them once, so entries that draw most vectors cost no more than the rest, and what goes to
the driver is a codebook: entries * dimension integers.

Rows whose vector is null or holds null or non-finite components are left out.  Shorter
vectors, and a dimension that the parts do not divide, count as padded with zeros.
Repeated rows each count.  Null ids come last, ties of an id in the
order of the vectors.  Integers are held to +-limit, the largest size whose
squared distances fit 63 bits (over 180,000 before scaling at 64 dimensions); a
label's error beyond 63 bits is null.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import load, share, shared_value, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096          # vectors of a matrix product
HOT_SHARE = 1000      # a label is hot from one in so many rows on: fewer than this are


# ------------------------------------------------------------------ exact products

def limb_width(dim: int) -> int:
    """Bits of a limb: ``dim`` products of two such limbs sum to at most 2^53."""
    return (53 - max(dim - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """x = sum of limb i * 2^(width i); the last limb carries the sign."""
    out, bound = [], int(np.abs(x).max(initial=0))
    while bound > 1 << width:
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x, bound = x >> width, (bound >> width) + 1
    return [*out, x.astype(np.float64)]


def exact_dots(x: np.ndarray, c: np.ndarray, width: int | None = None) -> np.ndarray:
    """x @ c.T of int64 matrices, modulo 2^64."""
    width = width or limb_width(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(limbs(c, width)):
            if width * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << np.int64(width * (i + j))
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) and squared distance of each row."""
    far = (book * book).sum(axis=1)[None, :] - 2 * exact_dots(x, book)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)


# ------------------------------------------------------------------ vectors of a batch

def kept_rows(column: pa.Array) -> np.ndarray:
    """True for vectors without null or non-finite components."""
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(length)
    seen = np.concatenate([[0], np.cumsum(bad)])
    return column.is_valid().to_numpy(zero_copy_only=False) & (seen[ends] == seen[ends - length])


def integers(column: pa.Array, dim: int, scale: int, limit: int) -> np.ndarray:
    """(rows, dim) floor(scale * x) of kept vectors, padded with zeros."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    x = np.clip(x, -limit, limit).astype(np.int64)
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(length) and (length == dim).all():
        return x.reshape(len(length), dim)
    out = np.zeros((len(length), dim), np.int64)
    out[np.arange(dim)[None, :] < length[:, None]] = x
    return out


def vector_blocks(batch: pa.RecordBatch, dim: int, scale: int, limit: int):
    """Yield (batch, integers) of at most BLOCK kept rows."""
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        yield part, integers(part.column("embedding"), dim, scale, limit)


class Model:
    """Codebooks of all parts and what turns vectors into integers."""

    def __init__(self, books: list[np.ndarray], dim: int, scale: int, limit: int):
        self.books, self.dim, self.scale, self.limit = books, dim, scale, limit

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def kept_vectors(df: DataFrame, label: str) -> DataFrame:
    """vec_id, label, embedding of the vectors that take part."""
    def step(batches):
        for batch in batches:
            yield batch.filter(pa.array(kept_rows(batch.column("embedding"))))

    chosen = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), "embedding")
    return chosen.mapInArrow(step, chosen.schema)


def first_model(vectors: DataFrame, parts: int, entries: int, scale: int) -> Model | None:
    """Codebooks of the first vectors by id; at most ``entries`` rows reach the driver."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    dim = -(-longest // parts) * parts
    limit = isqrt((2 ** 63 - 1) // (4 * max(dim, 1)))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    x = integers(start.column("embedding").combine_chunks(), dim, scale, limit)
    return Model(np.split(x, parts, axis=1), dim, scale, limit)


def refined(vectors: DataFrame, model: Model) -> Model:
    """One round: all parts assigned, each used entry the floored mean of its parts."""
    shared = share(vectors.sparkSession, model)
    wide = model.dim // len(model.books)

    def step(batches):
        m = shared_value(shared)
        sums = [np.zeros_like(b) for b in m.books]
        counts = [np.zeros(len(b), np.int64) for b in m.books]
        for batch in batches:
            for _, x in vector_blocks(batch, m.dim, m.scale, m.limit):
                for p, (part, book) in enumerate(zip(np.split(x, len(m.books), axis=1), m.books)):
                    own, _ = assign(part, book)
                    order = np.argsort(own, kind="stable")
                    used, first = np.unique(own[order], return_index=True)
                    sums[p][used] += np.add.reduceat(part[order], first, axis=0)
                    counts[p] += np.bincount(own, minlength=len(book))
        for p, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pylist(
                [{"part": p, "entry": int(e), "n": int(n[e]), "sums": s[e].tolist()} for e in used], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    partial = vectors.select("embedding").mapInArrow(step, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(wide)])
    books = [b.copy() for b in model.books]
    for row in total.collect():  # at most parts * entries rows
        books[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(wide)]
    return Model(books, model.dim, model.scale, model.limit)


def coded(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    shared = share(vectors.sparkSession, model)
    label = vectors.schema["label"].dataType

    def step(batches):
        m = shared_value(shared)
        for batch in batches:
            for rows, x in vector_blocks(batch, m.dim, m.scale, m.limit):
                code, error = np.zeros((rows.num_rows, len(m.books)), np.uint8), np.zeros(rows.num_rows, np.int64)
                for p, (part, book) in enumerate(zip(np.split(x, len(m.books), axis=1), m.books)):
                    code[:, p], far = assign(part, book)
                    error += far
                text = code.tobytes().hex()
                step_ = 2 * len(m.books)
                yield pa.RecordBatch.from_arrays([
                    rows.column("vec_id"), rows.column("label"),
                    pa.array([text[i:i + step_] for i in range(0, len(text), step_)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(step, vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long"))


def with_label_error(codes: DataFrame) -> DataFrame:
    """label_error: the errors summed over equal labels, nulls together.  Sums are
    combined before the shuffle; labels of at least one in HOT_SHARE rows (so fewer than
    HOT_SHARE labels) are joined by broadcast, the rest by a shuffle without hot keys."""
    codes = written(codes)
    sums = written(codes.groupBy("label").agg(F.count("*").alias("rows"), F.try_sum("error").alias("label_error")))
    least = max((sums.agg(F.sum("rows")).first()[0] or 0) // HOT_SHARE, 1)
    sums = sums.select(F.col("label").alias("_label"), "rows", "label_error")
    hot = F.broadcast(sums.filter(F.col("rows") > least).drop("rows"))
    same = codes["label"].eqNullSafe(F.col("_label"))
    often = codes.join(hot, same)
    rest = codes.join(hot, same, "left_anti")
    rare = rest.join(sums.filter(F.col("rows") <= least).drop("rows"), rest["label"].eqNullSafe(F.col("_label")))
    return often.unionByName(rare).drop("_label")


def vector_codes(df: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector.
    ``entries`` is at most 256: an index is one byte of the code."""
    vectors = kept_vectors(df, label)
    model = first_model(vectors, parts, entries, scale)
    if model is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        model = refined(vectors, model)
    out = with_label_error(coded(vectors, model))
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(load(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Rounds as plain relations: every distance, the least by (distance, index)."""
    head = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT place, p.part, list_slice(v, p.part * len(v) // 4 + 1, (p.part + 1) * len(v) // 4) AS x
  FROM kept, (SELECT unnest(range(4)) AS part) p),
book0 AS MATERIALIZED (SELECT part, place - 1 AS entry, x AS c FROM pieces WHERE place <= 256)"""
    near = """,
near{r} AS MATERIALIZED (
  SELECT place, part, any_value(x) AS x,
         min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + entry) AS best
  FROM pieces JOIN book{r} USING (part) GROUP BY place, part)"""
    step = """,
mean{r} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT part, best % 256 AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY ALL)
  GROUP BY part, entry),
book{q} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))"""
    rounds = "".join(near.format(r=r) + (step.format(r=r, q=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    tail = f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM (SELECT place, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
      FROM near{ROUNDS} GROUP BY place) JOIN kept USING (place)
"""
    return head + rounds + tail


ORACLE = _oracle()
