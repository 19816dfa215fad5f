"""Token-id files: patched frame-of-reference blocks with an index of block starts.

Documents are sorted by id into slices; each slice encodes its texts, ends
every document with END and writes the ids to files of about FILE_IDS ids, a
document never cut.  A file has

    magic, numbers of ids, blocks and documents, bytes of payload   (fixed header)
    doc_id, null flag and number of ids of each document
    start of each block in the payload                             (the index)
    payload: per block its least id, width, number of exceptions, packed ids,
    places and values of the exceptions

A block holds BLOCK ids (the last one of a file fewer).  Its least id is subtracted, the
rest is packed at the width that PERCENT of them fit, and larger ones are stored whole
in the exception list, so a few rare ids do not widen a block.  The index gives
any range of ids without reading the blocks before it (``read_ids``).

A task writes under a name of its own and renames at the end: a task that runs again
or twice leaves the same file.  Files go to a folder below ``spark.checkpoint.dir``
through pyarrow's file systems (local or mounted folders, hdfs, s3, gs).  The driver
sees one row a slice at most; files are counted in Spark.

Texts are encoded with the tokenizers library.  Where no match of the byte-level pattern can
hold the characters on both sides (a letter and a comma, a letter and a blank) a text may
be cut without changing its ids; each distinct piece of a task is encoded once (about
PIECES are kept).  Names of special tokens in a text are ordinary text.

A null text is empty: END alone.  Null ids come first, rows that share an id are ordered
by a hash of their text, equal rows follow each other.  Texts of any length are encoded whole.  An empty
table gives no rows and no files.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.llm.common import checkpoint, load, shuffle_width, text_blocks, use_shared_folder

END = 0
BLOCK = 1024
PERCENT = 95
FILE_IDS = 1 << 22
PIECES = 1 << 20
BLOCK_TEXT = 1 << 23      # bytes of text encoded at once
SLICE_BYTES = 1 << 26     # bytes of text in a slice
MAGIC = b"PFORIDS1"
HEADER = "<8sQQQQ"     # magic, ids, blocks, documents, payload bytes
BLOCK_HEADER = "<IBH"   # least id, width, exceptions
GROUP = 16                             # blocks packed or unpacked at once


# ------------------------------------------------------------------ blocks

def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers below 2^width as rows of bytes, lowest bit first."""
    bits = (x[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")


def unpack_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1, count=n * width, bitorder="little").reshape(len(raw), n, width)
    whole = np.zeros((len(raw), n), np.uint32)
    for k in range(width):
        whole |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return whole


def pack_blocks(x: np.ndarray) -> list[bytes]:
    """One frame-of-reference block for each row of uint32 numbers."""
    least = x.min(axis=1)
    rest = x - least[:, None]
    size = bit_lengths(rest)
    at = min(-(-x.shape[1] * PERCENT // 100), x.shape[1]) - 1
    width = np.partition(size, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        big = size[rows] > w
        packed = pack_bits(np.where(big, np.uint32(0), rest[rows]), w)
        for k, i in enumerate(rows.tolist()):
            place = np.flatnonzero(big[k])
            out[i] = b"".join((struct.pack(BLOCK_HEADER, int(least[i]), w, len(place)), packed[k].tobytes(),
                               place.astype("<u2").tobytes(), rest[i][place].astype("<u4").tobytes()))
    return out


def unpack_blocks(blocks: list[bytes], n: int) -> np.ndarray:
    """The rows of n numbers each that ``pack_blocks`` took."""
    heads = [struct.unpack_from(BLOCK_HEADER, b) for b in blocks]
    width = np.array([w for _, w, _ in heads])
    out = np.zeros((len(blocks), n), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        first = struct.calcsize(BLOCK_HEADER)
        last = first - (-n * w // 8)
        raw = np.frombuffer(b"".join(blocks[i][first:last] for i in rows.tolist()), np.uint8).reshape(len(rows), last - first)
        out[rows] = unpack_bits(raw, n, w) if w else 0
        for i in rows.tolist():
            more = heads[i][2]
            if more:
                place = np.frombuffer(blocks[i], "<u2", more, last)
                out[i, place] = np.frombuffer(blocks[i], "<u4", more, last + 2 * more)
    return out + np.array([m for m, _, _ in heads], np.uint32)[:, None]


def file_bytes(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """A file of documents whose ids follow each other."""
    full = len(ids) // BLOCK
    blocks = []
    for a in range(0, full, GROUP):
        blocks += pack_blocks(ids[a * BLOCK:min(a + GROUP, full) * BLOCK].reshape(-1, BLOCK))
    if len(ids) > full * BLOCK:
        blocks += pack_blocks(ids[full * BLOCK:].reshape(1, -1))
    payload = b"".join(blocks)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join((
        struct.pack(HEADER, MAGIC, len(ids), len(blocks), len(counts), len(payload)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u8").tobytes(), starts.astype("<u8").tobytes(), payload))


class TokenFile:
    """Reads a file's document table and index, then any range of its ids."""

    def __init__(self, source):
        self.source = source
        magic, self.n_ids, n_blocks, n_docs, size = struct.unpack(HEADER, source.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        ids = np.frombuffer(source.read(8 * n_docs), "<i8")
        null = np.frombuffer(source.read(n_docs), np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.counts = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)
        starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)
        self.starts = np.concatenate([starts, [size]])
        self.payload = struct.calcsize(HEADER) + 17 * n_docs + 8 * n_blocks

    def read_ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1; only their blocks are read."""
        a, b = first // BLOCK, -(-last // BLOCK)
        if first >= last:
            return np.zeros(0, np.uint32)
        self.source.seek(self.payload + int(self.starts[a]))
        raw = self.source.read(int(self.starts[b] - self.starts[a]))
        cuts = (self.starts[a:b + 1] - self.starts[a]).tolist()
        blocks = [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        full = b - a if b * BLOCK <= self.n_ids else b - a - 1
        out = [unpack_blocks(blocks[i:min(i + GROUP, full)], BLOCK).ravel() for i in range(0, full, GROUP)]
        if full < len(blocks):
            out.append(unpack_blocks(blocks[full:], self.n_ids - (b - 1) * BLOCK).ravel())
        return np.concatenate(out)[first - a * BLOCK:last - a * BLOCK]


# ------------------------------------------------------------------ texts

# Characters by byte: what may be in one match of the pattern with its neighbour.
WHITE, LETTER, DIGIT, MARK, QUOTE, OTHER = range(6)


def byte_classes() -> np.ndarray:
    """Class of each ASCII byte; OTHER is what a cut keeps away from."""
    out = np.full(256, OTHER, np.uint8)
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = WHITE
    out[0x21:0x7F] = MARK
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[0x27] = QUOTE
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places where a match of the byte-level pattern must start: no match holds
    the characters on both sides.  Not all such places, only those that bytes tell."""
    kind = classes[data]
    # U+00C0 to U+024F are letters but for the signs of multiplication and division
    latin = (data >= 0xC3) & (data <= 0xC9)
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    latin[signs] = False
    kind[latin] = LETTER
    kind[1:][latin[:-1]] = LETTER
    was, now = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    ends = (was != OTHER) & (now != OTHER) & (was != now)
    ends &= ~((was == QUOTE) & (now != WHITE)) & ~((was == MARK) & (now == QUOTE))   # marks, contractions
    # a blank goes with what follows; of a longer run of white space the last one may, too
    single = np.zeros(len(was), bool)
    single[1:] = (kind[:-2] != WHITE) & (kind[:-2] != OTHER) & (data[1:-1] != 0x20)
    cut[1:-1] = ends & ((was != WHITE) | single)
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of texts; equal pieces are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.classes = byte_classes()
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}   # stands for END
        # ids of all pieces behind each other; both arrays grow by doubling
        self.flat, self.ends, self.used = np.full(1024, END, np.uint32), np.ones(1024, np.int64), 1

    def add(self, pieces: list[bytes]) -> None:
        found = [e.ids for e in self.model.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        known = len(self.number)
        self.number.update(zip(pieces, range(known, known + len(pieces))))
        ends = self.used + np.cumsum([len(x) for x in found])
        while len(self.ends) < known + len(pieces):
            self.ends = np.concatenate([self.ends, self.ends])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, self.flat])
        self.ends[known:known + len(pieces)] = ends
        self.flat[self.used:ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) - self.used)
        self.used = int(ends[-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in UTF-8, END after each; and the number of ids of each."""
        if len(self.number) > PIECES:
            self.forget()
        starts = piece_starts(data, offsets, self.classes)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.number]
        if fresh:
            self.add(fresh)
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        codes = number[pieces.indices.to_numpy()]
        after = np.searchsorted(starts, offsets[1:])      # pieces up to the end of each text
        codes = np.insert(codes, after, 0)
        length = self.ends[codes] - np.where(codes > 0, self.ends[codes - 1], 0)
        total = np.cumsum(length)
        place = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.ends[codes] - total, length)
        return self.flat[place], np.diff(total[after + np.arange(len(after))], prepend=0)


# ------------------------------------------------------------------ files

def file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """slice, file, path, n_ids of each file written, in order of the documents."""
    file_ids = FILE_IDS

    def step(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer)
        files, root = file_system(folder)
        piece, attempt, done = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        ids, doc_ids, counts, held = [], [], [], 0

        def write():
            nonlocal ids, doc_ids, counts, held, done
            name = f"{piece:06d}-{done:06d}.ids"
            with files.open_output_stream(f"{root}/.{name}-{attempt}") as out:
                out.write(file_bytes(np.concatenate(ids), doc_ids, counts))
            files.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"slice": piece, "file": done, "path": f"{folder}/{name}", "n_ids": held}], schema=kind)
            ids, doc_ids, counts, held, done = [], [], [], 0, done + 1
            return row

        for batch in batches:
            for first, last, data, offsets in text_blocks(batch, limit=BLOCK_TEXT):
                found, sizes = encoder.encode(data, offsets)
                ids.append(found)
                doc_ids += batch.column("doc_id").slice(first, last - first).to_pylist()
                counts += sizes.tolist()
                held += len(found)
                if held >= file_ids:
                    yield write()
        if counts:
            yield write()

    kind = pa.schema([("slice", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())])
    keys = [F.col("doc_id").asc_nulls_first(), "_h", "_row"]  # ids that repeat are split
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"),
                       F.monotonically_increasing_id().alias("_row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SLICE_BYTES))
    slices = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpoint(slices.select("doc_id", "text").mapInArrow(step, "slice int, file int, path string, n_ids long"))


def with_starts(files: DataFrame) -> DataFrame:
    """Files with the number of ids before each: within its slice, and of the slices
    before (one row a slice)."""
    inside = Window.partitionBy("slice").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    slices = files.groupBy("slice").agg(F.sum("n_ids").alias("_all"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    files = files.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return files.join(slices, "slice").select("slice", "file", "path", (F.col("_before") + F.col("_inside")).alias("first_id"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.
    ``files``: path and first_id of each."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def step(batches):
        for batch in batches:
            for path, first_id in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                system, name = file_system(path)
                with system.open_input_file(name) as source:
                    f = TokenFile(source)
                    ends = np.cumsum(f.counts)
                    a = 0
                    while a < len(ends):  # documents of about a million ids at a time
                        base = int(ends[a] - f.counts[a])
                        b = max(int(np.searchsorted(ends, base + (1 << 20))), a + 1)
                        ids = f.read_ids(base, int(ends[b - 1])).astype("<u4")
                        cuts = (np.concatenate([[base], ends[a:b]]) - base).tolist()
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(f.doc_ids[a:b], pa.int64()), pa.array(ends[a:b] - f.counts[a:b] + first_id),
                            pa.array(f.counts[a:b]), pa.array(crc, pa.int64())], schema=kind)
                        a = b

    dealt = files.select("path", "first_id").repartition(shuffle_width(files.sparkSession), "path")
    return dealt.mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files written (path, first_id), and what reading them back gives."""
    spark = docs.sparkSession
    if folder is None:
        use_shared_folder(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    system, root = file_system(folder)
    system.create_dir(root)
    files = with_starts(write_files(docs, folder, tokenizer))
    return files, read_files(files)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[1]
