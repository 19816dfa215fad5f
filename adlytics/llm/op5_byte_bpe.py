"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation works on arrays.  Every code point gets a symbol (its class:
letter, number, white space, other; plus the blank, the apostrophe and the
letters of the English contractions).  A small automaton over these symbols
says whether an apostrophe opens a contraction; since the transition functions
of its states compose associatively, a block of text is scanned as many columns
at once: each column's composed function first, then the state entering each
column, then all states.  Borders follow from states and classes of neighbours
by array comparisons (the white-space rule needs one symbol of look-ahead).

The slices between borders feed a cache of merged pieces; offsets into the
token array delimit the documents again for decoding.

Null and empty texts have no tokens.  A text is never cut; a block holds at
least one whole text.  Repeated rows give repeated results, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adlytics.llm.common import load, text_blocks

# Symbols.  The first four are the classes of the pattern.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
BLANK, QUOTE = 4, 5                                    # ' ' is a SPACE, "'" is an OTHER
STMD, R, V, L, E = 6, 7, 8, 9, 10                       # letters that contractions use
N_SYMBOLS = 11
# Unicode White_Space, fixed values.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States after a code point.
IN_SPACE, AFTER_BLANK, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(10)
N_STATES = 10


def symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[list(WHITE_SPACE)] = SPACE
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for c in "stmd":
        table[ord(c)] = STMD
    for c, s in (("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(c)] = s
    return table


def transitions() -> np.ndarray:
    """(N_SYMBOLS, N_STATES): the state after a symbol."""
    t = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    t[LETTER], t[NUMBER], t[SPACE], t[OTHER], t[BLANK] = IN_LETTERS, IN_NUMBERS, IN_SPACE, IN_OTHER, AFTER_BLANK
    # an apostrophe starts a piece unless it continues other signs or follows a blank
    t[QUOTE] = AT_QUOTE
    for state in (IN_OTHER, AT_QUOTE, AFTER_BLANK):
        t[QUOTE, state] = IN_OTHER
    for s in (STMD, R, V, L, E):
        t[s] = IN_LETTERS
    t[STMD, AT_QUOTE] = CONTRACTED
    t[R, AT_QUOTE], t[V, AT_QUOTE], t[L, AT_QUOTE] = QUOTE_R, QUOTE_V, QUOTE_L
    t[E, QUOTE_R] = t[E, QUOTE_V] = t[L, QUOTE_L] = CONTRACTED
    return t


COLUMN = 128
_T = transitions()
_CLASS_OF = np.array([LETTER, NUMBER, SPACE, OTHER, SPACE, OTHER, LETTER, LETTER, LETTER, LETTER, LETTER], np.uint8)


def scan_states(symbols: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """State after each symbol; ``resets`` are the first symbols of the texts,
    which begin as if white space stood before them.

    A symbol that starts a text acts as a constant function.  The columns'
    functions are composed side by side, then applied.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    code = symbols.astype(np.int64)
    code[resets] += N_SYMBOLS
    table = np.concatenate([_T, np.repeat(_T[:, IN_SPACE:IN_SPACE + 1], N_STATES, axis=1),
                            np.arange(N_STATES, dtype=np.uint8)[None, :]]).astype(np.int64)  # last: identity
    width = -(-n // COLUMN)
    grid = np.full(width * COLUMN, 2 * N_SYMBOLS)
    grid[:n] = code
    grid = np.ascontiguousarray(grid.reshape(width, COLUMN).T) * N_STATES
    flat = table.ravel()
    # 1. the composed function of each column
    composed = np.repeat(np.arange(N_STATES)[:, None], width, axis=1)
    for row in grid:
        composed = flat[row[None, :] + composed]
    # 2. the state that enters each column
    enter, state = np.empty(width, np.int64), IN_SPACE
    for k, f in enumerate(composed.T.tolist()):
        enter[k] = state
        state = f[state]
    # 3. all states
    out, cur = np.empty((COLUMN, width), np.uint8), enter
    for j, row in enumerate(grid):
        cur = flat[row + cur]
        out[j] = cur
    return out.T.reshape(-1)[:n]


def borders(symbols: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where a piece starts.  ``text_starts``: first position of each
    non-empty text, ascending."""
    n = len(symbols)
    state = scan_states(symbols, text_starts)
    kind = _CLASS_OF[symbols]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    prev_kind = np.concatenate([[255], kind[:-1]])
    run = (kind != prev_kind) | first[:n]                  # a run of one class starts
    solid = kind != SPACE
    # a blank right before a solid run of the same text joins it
    blank_before = np.concatenate([[False], symbols[:-1] == BLANK]) & ~first[:n]
    start = run & ~(solid & blank_before)
    # white space: its last sign stands apart (or joins) if solid text follows
    next_solid = np.concatenate([solid[1:], [False]]) & ~first[1:]
    start |= ~solid & next_solid
    # contractions: no border behind the apostrophe, one behind the last letter
    done = np.flatnonzero(state == CONTRACTED)
    quote = np.where(state[done - 1] == AT_QUOTE, done - 1, done - 2)
    start[quote + 1] = False
    behind = done + 1
    start[behind[behind < n]] = True
    return np.flatnonzero(start)


# ------------------------------------------------------------------ merging

def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the pair of lowest rank, leftmost first.  A heap
    over a linked list keeps long pieces at n log n."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))      # end of the part that starts here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            r = ranks.get(piece[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0:
            r = ranks.get(piece[left[i]:stop])
            if r is not None:
                heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PieceCache(dict):
    """piece -> its ids as little-endian uint32 bytes; emptied when full."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge_piece(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_block(data: np.ndarray, offsets: np.ndarray, symbols_of: np.ndarray, cache: PieceCache) -> list[bytes]:
    """The ids of each text as little-endian uint32 bytes."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)            # byte offset of each code point
    begins = offsets[:-1][np.diff(offsets) > 0]
    where = borders(symbols_of[points], np.searchsorted(lead, begins))
    cuts = lead[where]
    per_text = np.searchsorted(cuts, offsets)
    cuts = cuts.tolist() + [len(raw)]
    pieces = [cache[raw[a:b]] for a, b in zip(cuts, cuts[1:])]
    return [b"".join(pieces[a:b]) for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist())]


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def token_list(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _shared(spark: SparkSession, vocabulary: str):
    """Ranks and symbols for the tasks: both of fixed size (the vocabulary file
    and one byte per code point)."""
    return spark.sparkContext.broadcast((load_ranks(vocabulary), symbol_table()))


def encode(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids (array<int>), n_tokens and round_trip: whether the
    decoded ids are the text's bytes again."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared = _shared(docs.sparkSession, vocabulary)

    def step(batches):
        ranks, symbols = shared.value
        cache, tokens = PieceCache(ranks), token_list(ranks)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                ids = encode_block(data, offsets, symbols, cache)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                                 pa.array(np.frombuffer(b"".join(ids), "<i4")))
                same = [decode(x, tokens) == data[a:b].tobytes() for x, a, b in zip(ids, offsets[:-1], offsets[1:])]
                yield _rows(batch, first, last, keep, ids=lists, n_tokens=pa.array(n), round_trip=pa.array(same, pa.bool_()))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(step, _schema(docs, keep, "ids array<int>, n_tokens long, round_trip boolean"))


def digests(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids and of the decoded bytes,
    so that neither leaves the task that made it."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared = _shared(docs.sparkSession, vocabulary)

    def sha(x):
        return hashlib.sha256(x).hexdigest()

    def step(batches):
        ranks, symbols = shared.value
        cache, tokens = PieceCache(ranks), token_list(ranks)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                ids = encode_block(data, offsets, symbols, cache)
                yield _rows(batch, first, last, keep,
                            n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
                            ids_sha256=pa.array([sha(x) for x in ids], pa.string()),
                            decoded_sha256=pa.array([sha(decode(x, tokens)) for x in ids], pa.string()))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(step, _schema(docs, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _rows(batch: pa.RecordBatch, first: int, last: int, keep, **new) -> pa.RecordBatch:
    kept = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in keep]
    return pa.RecordBatch.from_arrays(kept + list(new.values()), names=[*keep, *new])


def _schema(df: DataFrame, keep, more: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [more])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
