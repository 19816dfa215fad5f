import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers as P

from adlytics.llm import op5_byte_bpe as op
from adlytics.llm.common import text_bytes
from .helpers import documents, rng, with_clashes

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op.load_ranks(PATH), special_tokens={})


def texts():
    r = rng(1)
    signs = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "#", " ", "　", "日", "😀",
             "'re", "'ll", "'ve", "\x1c", "́", "ß", "S", " "]
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r.shuffle(points)
    out += ["".join(points[i:i + 60]) for i in range(0, 60_000, 60)]
    return out + ["", "x", "a" * 5000, " " * 3000, "'" * 999, "'s" * 500, "don't we'll 'tis I'm", " lead", "trail \n "]


def test_ids_equal_the_library(library):
    data, offsets = text_bytes(pa.array(texts()))
    ranks = op.load_ranks(PATH)
    tokens = op.token_list(ranks)
    got = op.encode_block(data, offsets, op.symbol_table(), op.PieceCache(ranks, limit=500))
    for text, ids in zip(texts(), got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert op.decode(ids, tokens) == text.encode()


def test_scan_equals_step_by_step():
    r = rng(8)
    symbols = np.array([r.randrange(op.N_SYMBOLS) for _ in range(1000)], np.uint8)
    starts = np.array(sorted(r.sample(range(1000), 30) + [0]))
    state, want = op.IN_SPACE, []
    for i, s in enumerate(symbols):
        state = op.transitions()[s, op.IN_SPACE if i in set(starts.tolist()) else state]
        want.append(state)
    assert op.scan_states(symbols, np.unique(starts)).tolist() == want


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "it's"), (3, "it's"), (None, "z"), (4, "word " * 40_000)]
    got = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in op.digests(with_clashes(documents(spark, rows))).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    full = op.encode(documents(spark, rows)).collect()
    assert all(x.round_trip and len(x.ids) == x.n_tokens for x in full) and len(full) == len(rows)
    assert op.digests(documents(spark, [])).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in op.op5_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(text[x.doc_id])
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text[x.doc_id].encode()).hexdigest()
