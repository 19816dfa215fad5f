"""Numpy views of Arrow text batches, 64-bit mixing, and small Spark helpers."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the word contracts: blank and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 21


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: cuts lineage, survives executor loss."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, as a compressed table, for what is large."""
    spark = df.sparkSession
    use_shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver's garbage collector finds
    nothing that refers to it; after a step with a large shuffle, ask it to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def share(spark: SparkSession, value):
    """A broadcast of a value of bounded size whose class is of this subpackage:
    sent by value, as the functions are, for executors without the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared):
    return pickle.loads(shared.value)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ text in numpy

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without copying; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type) or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:
        # a null slot may own bytes: copy the valid rows only
        values = [v or b"" for v in col.to_pylist()]
        data = np.frombuffer(b"".join(values), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (first, last) whose texts hold about ``limit`` bytes; a longer
    text is a block of its own, never cut."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES):
    """Yield (first, last, data, offsets) per block, offsets starting at 0."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for first, last in blocks(offsets, limit):
        o = offsets[first:last + 1]
        yield first, last, data[o[0]:o[-1]], o - o[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return np.random.default_rng(seed).integers(0, 2 ** 64, 256, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words (runs without ASCII white space); none
    crosses a text border."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inside = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # text borders
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty, ordered, disjoint byte span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    marks = np.zeros(len(data), np.int64)
    marks[starts] = np.diff(starts, prepend=0)
    place -= np.cumsum(marks)  # position inside the span (junk outside spans)
    value = table[data] + mix64(place.astype(np.uint64) + np.uint64(1)) * (table[data] | np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value), dtype=np.uint64)])
    return mix64(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def empty_batches(schema: pa.Schema):
    return pa.RecordBatch.from_pylist([], schema=schema)
