"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else, too.

1. Anchors.  Of every LENGTH-byte window the position with the least 16-gram
   hash among its first WINDOW positions is an anchor; equal windows have
   their anchor at the same place.  One position in about 80 is an anchor.  Anchors whose
   next CORE bytes occur once cannot lie in a repeated window and are left out
   (by a 64-bit hash of those bytes, counted over the corpus).
2. Runs.  Each task sorts the suffixes at its anchors (LENGTH bytes to the
   right, WINDOW - 1 to the left as payload), merges equal ones, front-codes
   the sorted suffixes against their predecessors and sends each bucket its
   run.  Buckets are hashes of the first CORE bytes, since only suffixes that
   share those matter to each other.
3. Merge.  A bucket's runs are merged by a loser tree that keeps, at every
   node, the common prefix of the loser and the winner that passed it: prefixes known
   to be equal are never compared again, and most matches are decided by
   comparing two prefix lengths.  The merge gives the sorted order and its
   common-prefix array.
4. Windows.  The window that starts l bytes before an anchor repeats if another
   suffix shares LENGTH - l bytes to the right (same class in the common-prefix
   array at that depth) and l bytes to the left.  All windows of an anchor
   contain it, so the repeated ones cover one interval around it.  The union
   of the intervals of all anchors is exactly what has to go.

Equal contexts are one entry, and its places in a row of text that lie within
LENGTH of each other are one chain, so copies and periodic texts stay small.  An anchor
string with more than HOT different contexts would still fill one bucket; the
windows of its contexts are counted one by one instead, by a grouping with map-side
combine.  The result is the same.

A null text is empty; texts under LENGTH bytes keep all bytes.  Repeated rows (equal
doc_id and text) repeat each other, as any equal texts do: nothing of them is left if they have
LENGTH bytes, and one of them stands for all in the search.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import byte_table, checkpoint, load, mix64, shuffle_width, text_blocks, written

LENGTH = 200          # bytes of a repeat
GRAM = 16             # bytes hashed to choose anchors
WINDOW = 160          # positions among which the anchor is chosen
CORE = LENGTH - WINDOW
HOT = 100_000         # different contexts of one anchor string
BUCKETS = 2           # per shuffle partition
RUN_BYTES = 48 << 20  # contexts held by a task before it emits its runs
GRAM_SEED = 7
NO_ID = -(2 ** 63)


# ------------------------------------------------------------------- anchors

def _gram_hashes(data: np.ndarray, table: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 8 and 16 bytes from every position (shorter at the end)."""
    h = table[data]
    out, size = {}, 1
    while size < GRAM:
        nxt = np.zeros_like(h)
        nxt[:-size] = h[size:]
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + nxt) if size == 1 else h * np.uint64(0x9E3779B97F4A7C15) + (nxt ^ (h >> np.uint64(29)))
        size *= 2
        if size >= 8:
            out[size] = h
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hash of the CORE bytes from each), ascending."""
    length = np.diff(offsets)
    whole = np.flatnonzero(length >= LENGTH)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _gram_hashes(data, table)
    n = len(data)
    # hash above, position below: the least is the leftmost of equal hashes
    key = (mix64(grams[GRAM]) & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= WINDOW:
        nxt = least.copy()
        np.minimum(least[:-width], least[width:], out=nxt[:-width])
        least, width = nxt, width * 2
    if width < WINDOW:
        rest = WINDOW - width
        nxt = least.copy()
        np.minimum(least[:-rest], least[rest:], out=nxt[:-rest])
        least = nxt
    # a window starts at every position that has LENGTH bytes of its text after it
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, offsets[:-1][whole], 1)
    np.add.at(ok, offsets[1:][whole] - LENGTH + 1, -1)
    at = (least[np.cumsum(ok[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    core = grams[16][at] * np.uint64(3) + mix64(grams[16][at + 16]) * np.uint64(5) + mix64(grams[8][at + 32] + np.uint64(1))
    return at, mix64(core)


def anchor_rows(texts: DataFrame, with_place: bool) -> DataFrame:
    """core, and k1, k2 (the row) and pos (byte offset) on request."""
    def step(batches):
        table = byte_table(GRAM_SEED)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                at, core = anchors(data, offsets, table)
                columns = {"core": pa.array(core.view(np.int64))}
                if with_place:
                    row = np.searchsorted(offsets, at, side="right") - 1
                    for k in ("k1", "k2"):
                        columns[k] = pa.array(batch.column(batch.schema.get_field_index(k)).to_numpy()[first:last][row])
                    columns["pos"] = pa.array((at - offsets[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if with_place:
        return texts.select("k1", "k2", "text").mapInArrow(step, "core long, k1 long, k2 long, pos int")
    return texts.select("text").mapInArrow(step, "core long")


# ------------------------------------------------------------ front-coded runs

def pack_run(rights: list[bytes], lefts: list[bytes], times: list[int], groups: list[list[list[int]]]) -> bytes:
    """A sorted run: per suffix the bytes shared with its predecessor and the
    rest, its left context, how often it occurs, and the chains of its places
    (k1, k2, first, last)."""
    shared = common_prefixes(rights)
    size = np.array([len(r) for r in rights], np.int64)
    parts = (
        shared.astype(np.uint8).tobytes(),
        (size - shared).astype(np.uint8).tobytes(),
        b"".join([r[h:] for r, h in zip(rights, shared.tolist())]),
        np.array([len(x) for x in lefts], np.uint8).tobytes(),
        b"".join(lefts),
        np.array(times, np.int64).tobytes(),
        np.array([len(g) for g in groups], np.int32).tobytes(),
        np.array([p for g in groups for p in g], np.int64).tobytes(),
    )
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<8q", *map(len, parts)) + b"".join(parts))


def unpack_run(raw: bytes):
    """Iterator of (shared, suffix), left sizes and contexts, times, number of
    chains, chains of a run."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    cuts = np.cumsum([64, *struct.unpack_from("<8q", raw)])
    shared, rest, tails, left_size, lefts, times, chains, places = (raw[a:b] for a, b in zip(cuts, cuts[1:]))

    def suffixes():
        last, at = b"", 0
        for h, r in zip(shared, rest):
            last = last[:h] + tails[at:at + r]
            at += r
            yield h, last

    return (suffixes(), np.frombuffer(left_size, np.uint8), np.frombuffer(lefts, np.uint8), np.frombuffer(times, np.int64),
            np.frombuffer(chains, np.int32), np.frombuffer(places, np.int64).reshape(-1, 4))


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the one before it (the first: 0)."""
    if len(strings) < 2:
        return np.zeros(len(strings), np.int64)
    size = np.array([len(s) for s in strings])
    grid = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in strings), np.uint8).reshape(-1, LENGTH)
    differ = grid[1:] != grid[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))])


def contexts(batches):
    """(core, right, left) context and (k1, k2, pos) of every anchor of the rows."""
    for batch in batches:
        k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        for i, (text, found) in enumerate(zip(batch.column("text"), batch.column("found"))):
            text = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for pos, core in sorted({(f["pos"], f["core"]) for f in found.as_py()}):
                yield (core, text[pos:pos + LENGTH], text[max(0, pos - WINDOW + 1):pos][::-1]), k1[i], k2[i], pos


def _runs(n_buckets: int):
    """Task step: sorted, front-coded runs by bucket of the rows' anchors."""
    def emit(held):
        by_bucket: dict[int, list] = {}
        for (core, right, left), (times, chains) in held.items():
            by_bucket.setdefault(core % n_buckets, []).append((right, left, times, chains))
        rows = []
        for bucket, entries in by_bucket.items():
            entries.sort(key=lambda e: (e[0], e[1]))
            rows.append((bucket, pack_run(*map(list, zip(*entries)))))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())],
                                          names=["bucket", "run"])

    def step(batches):
        held, size = {}, 0
        for context, k1, k2, pos in contexts(batches):
            entry = held.get(context)
            if entry is None:
                held[context] = entry = [0, []]
                size += 3 * LENGTH
            entry[0] += 1
            chains = entry[1]
            # places of one row come in order; near ones give one interval
            if chains and chains[-1][0] == k1 and chains[-1][1] == k2 and 0 < pos - chains[-1][3] <= LENGTH:
                chains[-1][3] = pos
            else:
                chains.append([k1, k2, pos, pos])
                size += 150
            if size > RUN_BYTES:
                yield emit(held)
                held, size = {}, 0
        if held:
            yield emit(held)

    return step


# ------------------------------------------------------------------ loser tree

def extend(a: bytes, b: bytes, h: int) -> int:
    """Common prefix of a and b, of which h bytes are known."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h:h + 16] == b[h:h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


def merge_runs(runs: list) -> tuple[list[int], list[int]]:
    """(run of each suffix, bytes shared with the suffix before it) in sorted
    order.  ``runs`` are iterators of (shared with predecessor, suffix).

    Every node holds the loser of its match and the prefix it shares with the
    winner.  A new head shares a known prefix with the last winner, as does
    each loser on its way: the one that shares more is smaller; only if both share
    the same are their bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    head: list = [None] * k      # current suffix of each run, None when it is used up
    lcp = [0] * k                # prefix shared with the last winner (heads) or the winner met (losers)
    sources = list(runs) + [iter(())] * (k - len(runs))
    for i, run in enumerate(sources):
        got = next(run, None)
        head[i] = got[1] if got is not None else None
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads whose lcp refer to the same suffix."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        h = extend(x, y, lcp[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    winner = [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1] if k > 1 else 0
    order, shared = [], []
    while head[top] is not None:
        order.append(top)
        shared.append(lcp[top])
        got = next(sources[top], None)
        if got is None:
            head[top], lcp[top] = None, 0
        else:
            lcp[top], head[top] = got
        cur, node = top, (top + k) >> 1
        while node:
            other = loser[node]
            x, y = lcp[cur], lcp[other]
            if head[cur] is None or head[other] is None or x == y:
                cur, loser[node] = play(cur, other)
            elif x < y:
                cur, loser[node] = other, cur
            node >>= 1
        top = cur
    return order, shared


# ------------------------------------------------------------------- windows

def repeated_depths(shared: np.ndarray, right: np.ndarray, left: np.ndarray, left_size: np.ndarray,
                    times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest depth d at which the suffix's window (d bytes to the
    right, LENGTH - d to the left) occurs more than once; 0, 0 if none does.
    ``right``: bytes to the right, ``left``: (suffixes, WINDOW - 1) bytes leftwards."""
    n = len(shared)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    h = np.zeros(n, np.uint64)
    near = np.maximum(shared, np.concatenate([shared[1:], [0]]))
    near = np.where(times > 1, LENGTH, near)  # deepest class the suffix has company in
    bits = max(4, int(n).bit_length() + 2)
    for l in range(WINDOW):
        d = LENGTH - l
        if l:
            h = mix64(h + left[:, l - 1].astype(np.uint64) + np.uint64(1))
        live = np.flatnonzero((left_size >= l) & (right >= d) & (near >= d))
        if not len(live):
            continue
        group = np.cumsum(shared < d)
        key = mix64(h[live] + group[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cell = (key >> np.uint64(64 - bits)).astype(np.int64)
        # equal keys by a table of cells; keys that meet another one's cell are sorted
        first = np.zeros(1 << bits, np.uint64)
        first[cell] = key
        own = first[cell] == key
        total = np.bincount(cell[own], weights=times[live][own], minlength=1 << bits)
        again = own & (total[cell] > 1)
        other = np.flatnonzero(~own)
        if len(other):
            _, which = np.unique(key[other], return_inverse=True)
            again[other] = np.bincount(which, weights=times[live][other])[which] > 1
        hit = live[again]
        high[hit] = np.maximum(high[hit], d)
        low[hit] = d
    return low, high


def resolve(blobs: list[bytes]) -> pd.DataFrame:
    """k1, k2, start, end of the intervals that a bucket's runs show to be repeated."""
    runs = [unpack_run(b) for b in blobs]

    lengths: list[list[int]] = [[] for _ in runs]

    def noting(i, suffixes):
        for h, s in suffixes:
            lengths[i].append(len(s))
            yield h, s

    order, shared = merge_runs([noting(i, r[0]) for i, r in enumerate(runs)])
    order = np.array(order, np.int64)
    # stable order of the suffixes: run by run in turn -> merged
    at = np.empty(len(order), np.int64)
    base = np.cumsum([0] + [len(x) for x in lengths])
    for i in range(len(runs)):
        at[order == i] = base[i] + np.arange(len(lengths[i]))
    join = lambda j: np.concatenate([r[j] for r in runs])
    left_size, times, chains = join(1).astype(np.int64), join(3), join(4)
    left = np.zeros((len(order), WINDOW - 1), np.uint8)
    left[np.arange(WINDOW - 1)[None, :] < left_size[:, None]] = join(2)
    right = np.concatenate([np.array(x, np.int64) for x in lengths])
    low, high = repeated_depths(np.array(shared, np.int64), right[at], left[at], left_size[at], times[at])
    by_entry_low, by_entry_high = np.empty_like(low), np.empty_like(high)
    by_entry_low[at], by_entry_high[at] = low, high
    places = join(5)
    entry = np.repeat(np.arange(len(times)), chains)
    hit = by_entry_high[entry] > 0
    p, e = places[hit], entry[hit]
    return pd.DataFrame({"k1": p[:, 0], "k2": p[:, 1], "start": p[:, 2] - (LENGTH - by_entry_low[e]), "end": p[:, 3] + by_entry_high[e]})


# ------------------------------------------------- anchors of very common strings

def _name(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join([b"%d" % len(p) for p in parts] + list(parts)), digest_size=8).digest(), "little", signed=True)


def _context_rows(batches):
    """core, context: each context once per batch of rows."""
    for batch in batches:
        seen = {(c[0], _name(c[1], c[2])) for c, _, _, _ in contexts([batch])}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.int64()) for k in (0, 1)], names=["core", "context"])


def _place_rows(batches):
    """context, k1, k2, pos."""
    for batch in batches:
        rows = [(_name(c[1], c[2]), k1, k2, pos) for c, k1, k2, pos in contexts([batch])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["context", "k1", "k2", "pos"])


def _window_rows(batches):
    """window, context, depth, times: the windows of each context of a batch."""
    for batch in batches:
        held: dict[tuple[bytes, bytes], int] = {}
        for c, _, _, _ in contexts([batch]):
            held[c[1:]] = held.get(c[1:], 0) + 1
        for (right, left), times in held.items():
            whole, at = left[::-1] + right, len(left)
            depths = [d for d in range(LENGTH, CORE, -1) if LENGTH - d <= at and d <= len(right)]
            names = [_name(whole[at - (LENGTH - d):at + d]) for d in depths]
            n = len(depths)
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int64()), pa.array([_name(right, left)] * n, pa.int64()), pa.array(depths, pa.int32()),
                pa.array([times] * n, pa.int64())], names=["window", "context", "depth", "times"])


def hot_intervals(rows: DataFrame) -> DataFrame:
    """As the buckets give, for anchors that are too common for one."""
    windows = rows.mapInArrow(_window_rows, "window long, context long, depth int, times long")
    again = windows.groupBy("window", "depth").agg(F.sum("times").alias("n")).filter("n > 1").select("window", "depth")
    hit = (windows.select("window", "depth", "context").join(again, ["window", "depth"], "left_semi").groupBy("context")
           .agg(F.min("depth").alias("low"), F.max("depth").alias("high")))
    places = rows.mapInArrow(_place_rows, "context long, k1 long, k2 long, pos long")
    return places.join(hit, "context").select(
        "k1", "k2", (F.col("pos") - (LENGTH - F.col("low"))).alias("start"), (F.col("pos") + F.col("high")).alias("end"))


# --------------------------------------------------------------------- operator

def keyed(docs: DataFrame) -> DataFrame:
    """k1 (doc_id, NO_ID for null), k2 (hash of the text), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """k1, k2, text, spans: every row with the (overlapping) byte intervals
    that repeated strings cover."""
    texts = keyed(docs)
    again = checkpoint(texts.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"))
    if again.isEmpty():
        return spans_of(texts, hot)
    alone, copies = texts.join(again, ["k1", "k2"], "left_anti"), texts.join(again, ["k1", "k2"], "left_semi")
    once = written(alone.unionByName(copies.dropDuplicates(["k1", "k2"])))
    found = spans_of(once, hot).join(again, ["k1", "k2"], "left_anti")
    size = F.octet_length("text").cast("long")
    whole = F.when(size >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))))
    return found.unionByName(copies.withColumn("spans", whole))


def spans_of(texts: DataFrame, hot: int) -> DataFrame:
    """``repeated_spans`` of rows of which no two have one key."""
    spark = texts.sparkSession
    common = checkpoint(anchor_rows(texts, False).groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"))
    placed = anchor_rows(texts, True)

    def rows_with(cores: DataFrame) -> DataFrame:
        found = (placed.join(cores.select("core"), "core", "left_semi").groupBy("k1", "k2")
                 .agg(F.collect_list(F.struct("pos", "core")).alias("found")))
        return texts.join(found, ["k1", "k2"]).select("k1", "k2", "text", "found")

    # many occurrences may still be few contexts, so contexts are counted where it matters
    often, very = common.filter(F.col("n") > hot), None
    if not often.isEmpty():
        seen = rows_with(often).mapInArrow(_context_rows, "core long, context long").distinct().groupBy("core").count()
        very = checkpoint(seen.filter(F.col("count") > hot).select("core"))
        very = None if very.isEmpty() else very
    usual = common if very is None else common.join(very, "core", "left_anti")
    runs = rows_with(usual).mapInArrow(_runs(BUCKETS * shuffle_width(spark)), "bucket int, run binary")
    spans = runs.groupBy("bucket").applyInPandas(lambda f: resolve(list(f["run"])), "k1 long, k2 long, start long, end long")
    if very is not None:
        spans = spans.unionByName(hot_intervals(rows_with(very)))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans, ["k1", "k2"], "left")


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted({(s["start"], s["end"]) for s in spans or ()}):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(batches):
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "removed", "kept")}
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw, gone = (text.as_py() or "").encode("utf-8", "surrogatepass"), _merged(spans.as_py())
            borders = [0, *[x for ab in gone for x in ab], len(raw)]
            columns["n_bytes"].append(len(raw))
            columns["n_removed"].append(sum(b - a for a, b in gone))
            columns["removed"].append([{"start": a, "end": b} for a, b in gone])
            columns["kept"].append(b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])))
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(),
                 "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        yield pa.RecordBatch.from_arrays([batch.column("k1")] + [pa.array(v, types[c]) for c, v in columns.items()], names=["k1", *columns])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte spans), kept (binary) per row."""
    out = repeated_spans(docs, hot).select("k1", "text", "spans").mapInArrow(
        _kept, "k1 long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("k1") != NO_ID, F.col("k1"))).select("doc_id", "n_bytes", "n_removed", "removed", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
