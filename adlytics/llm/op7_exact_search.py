"""Exact top-k inner-product search with a pivot-distance index.

Largest inner products become nearest neighbours by one more coordinate
sqrt(M^2 - |x|^2), M the largest norm: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
In that space every vector is keyed by its nearest pivot and cut into annuli
by its distance to the pivot.  For a query at distance d from a pivot, an
annulus [lo, hi) holds nothing nearer than max(lo - d, d - hi, 0): the
triangle inequality bounds the inner products it can hold.

The search expands annuli in the order of that bound, in two waves: each query
first visits the WAVE annuli of best bound, which gives its k-th score so far;
then only those of the rest whose bound is not below that score.  Both waves
join annulus pieces of at most about PIECE vectors with blocks of queries, so
a popular annulus is many tasks and no pair of vectors becomes a row.

Pivots and annulus edges come from a bounded sample (SAMPLE rows of smallest
hash); they only set the speed.  Bounds carry a slack for rounding, and scores
are integers computed exactly, so results are exact whatever the sample.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors count as padded with zeros.  Rows that repeat (vec_id, vector)
count once; rows with a query's vec_id are never its candidates.  Ties go to
the smaller vec_id.  Extra columns are ignored.  Scores beyond 64 bits wrap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.llm.common import checkpoint, load, share, shared_value

K = 5
PIVOTS = 32
RINGS = 16
SAMPLE = 8192
WAVE = 24
PIECE = 4096
QUERY_BLOCK = 512


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: array<long> floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return (df.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
              .dropDuplicates(["vec_id", "v"]))


def stack(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the extra coordinate sqrt(M^2 - |x|^2)."""
    x = x.astype(np.float64)
    extra = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, extra[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


class Index:
    """Pivots, annulus edges and the constants that bounds need."""

    def __init__(self, sample: np.ndarray, dim: int, top: float, largest: float):
        self.dim, self.top, self.exact = dim, top, largest * largest * max(dim, 1) < 2 ** 53
        points = lift(sample, top)
        chosen = [0]
        near = distances(points, points[:1])[:, 0]
        for _ in range(min(PIVOTS, len(points)) - 1):  # the farthest point next
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
        self.pivots = points[chosen]
        own, dist = self.nearest(points)
        cuts = np.linspace(0, 1, RINGS + 1)[1:-1]
        self.edges = np.array([np.quantile(dist[own == p], cuts) if (own == p).any() else np.zeros(RINGS - 1)
                               for p in range(len(self.pivots))])
        self.slack = 1e-6 * (np.sqrt(top) + 1.0)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(points, self.pivots)
        own = d.argmin(1)
        return own, d[np.arange(len(d)), own]

    def ring(self, x: np.ndarray) -> np.ndarray:
        own, dist = self.nearest(lift(x, self.top))
        return own * RINGS + (dist[:, None] >= self.edges[own]).sum(1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, annuli): no vector of the annulus has a larger inner product."""
        q = q.astype(np.float64)
        point = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        d = distances(point, self.pivots)[:, :, None]
        lo = np.concatenate([np.zeros((len(self.pivots), 1)), self.edges], axis=1)[None]
        hi = np.concatenate([self.edges, np.full((len(self.pivots), 1), np.inf)], axis=1)[None]
        gap = np.maximum(np.maximum(lo - d, d - hi) - self.slack, 0.0).reshape(len(q), -1)
        best = ((q * q).sum(1)[:, None] + self.top - gap * gap) / 2.0
        return best + 1e-9 * (np.abs(best) + self.top) + 1.0

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q @ x.T


def _pack(rows: np.ndarray) -> bytes:
    return rows.astype("<i8").tobytes()


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)


def top_k(df: DataFrame, is_query, k: int = K, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = checkpoint(quantised(df, scale))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    size = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(squares).alias("top"),
                       F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("largest")).first()
    if size["dim"] is None:
        return empty
    dim = max(size["dim"], 1)
    sample = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toPandas()["v"]
    shared = share(spark, Index(stack(sample, dim), dim, size["top"], float(size["largest"] or 0)))

    def assign(frames):
        index = shared_value(shared)
        for f in frames:
            x = stack(f["v"], dim)
            yield pd.DataFrame({"ring": index.ring(x), "vec_id": f["vec_id"], "v": [_pack(r) for r in x]})

    ringed = checkpoint(vectors.mapInPandas(assign, "ring long, vec_id long, v binary"))
    # pieces per annulus: at most PIVOTS * RINGS rows
    counts = ringed.groupBy("ring").count()
    split = F.broadcast(counts.select("ring", F.ceil(F.col("count") / PIECE).alias("pieces")))

    def pack_piece(f: pd.DataFrame) -> pd.DataFrame:
        # a piece is near PIECE rows; hashing may make it somewhat larger
        return pd.DataFrame({"ring": [int(f["ring"].iloc[0])], "ids": [f["vec_id"].to_numpy("<i8").tobytes()], "xs": [b"".join(f["v"])]})

    pieces = (ringed.join(split, "ring")
              .withColumn("piece", F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces")))
              .groupBy("ring", "piece").applyInPandas(
                  lambda f: pack_piece(f), "ring long, ids binary, xs binary"))
    pieces = checkpoint(pieces)
    queries = ringed.filter(is_query(F.col("vec_id"))).select("vec_id", "v")

    def visits(first_wave: bool):
        """Per block of queries one row for each annulus that some of them visit."""
        def step(frames):
            index = shared_value(shared)
            for f in frames:
                for a in range(0, len(f), QUERY_BLOCK):
                    g = f.iloc[a:a + QUERY_BLOCK]
                    q = _unpack(b"".join(g["v"]), dim)
                    bound = index.bounds(q)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, :WAVE]
                    early = np.zeros(bound.shape, bool)
                    np.put_along_axis(early, order, True, axis=1)
                    go = early if first_wave else ~early & (bound >= g["floor"].to_numpy(np.float64)[:, None])
                    ids = g["vec_id"].to_numpy("<i8")
                    rows = [(r, ids[go[:, r]].tobytes(), _pack(q[go[:, r]])) for r in np.flatnonzero(go.any(axis=0))]
                    yield pd.DataFrame(rows, columns=["ring", "q_ids", "qs"])
        return step

    def score(frames):
        index = shared_value(shared)
        for f in frames:
            for q_ids, qs, ids, xs in zip(f["q_ids"], f["qs"], f["ids"], f["xs"]):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                by_id = np.argsort(ids, kind="stable")
                ids, x = ids[by_id], _unpack(xs, dim)[by_id]
                s = index.scores(_unpack(qs, dim), x)
                out = []
                for i, q_id in enumerate(q_ids):
                    keep = np.flatnonzero(ids != q_id)
                    best = keep[np.argsort(-s[i, keep], kind="stable")[:k]]
                    out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[best], "score": s[i, best]}))
                if out:
                    yield pd.concat(out)

    def search(visit: DataFrame) -> DataFrame:
        return visit.join(pieces, "ring").select("q_ids", "qs", "ids", "xs").mapInPandas(
            score, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def keep_best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    early = checkpoint(keep_best(search(queries.mapInPandas(visits(True), "ring long, q_ids binary, qs binary"))))
    floors = early.filter(F.col("rank") == k).select(F.col("query_id"), F.col("score").alias("floor"))
    later = (queries.join(floors, queries["vec_id"] == floors["query_id"], "left")
             .select("vec_id", "v", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor")))
    late = search(later.mapInPandas(visits(False), "ring long, q_ids binary, qs binary"))
    found = early.select("query_id", "vec_id", "score").unionByName(late)
    return keep_best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
