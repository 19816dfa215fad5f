import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from adlytics.llm import op13_token_files as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def brute(rows, library):
    """Documents in order, each text encoded whole."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slice", "2 as file", "'x' as path", "0L as n_ids", "5 as _h")
    return [tuple(r) for r in op.token_files(df, PATH)[1].orderBy("start").collect()]


TEXTS = ["", None, " ", "  two  blanks ", "a b", " lead", "trail ", "line\n next\n\n end", "tab\t x \t y", "it's we'll 12 345 !? <|endoftext|> é中文  x   y",
         "x \u0085 y \x1c z", "😀 emoji 😀😀", "wide　 gap", "a" * 500, "0 " * 200]


@pytest.mark.parametrize("file_ids", [1 << 22, 700])
def test_equals_the_library(spark, library, monkeypatch, file_ids):
    monkeypatch.setattr(op, "FILE_IDS", file_ids)
    rows = [(i * 17 % 101 - 5, TEXTS[i % len(TEXTS)]) for i in range(101)] + [(900, "very long text, " * 20_000)]
    assert run(spark, rows) == brute(rows, library)


def test_ids_that_repeat(spark, library):
    """Rows that share an id or have none: any order among them, all of them there."""
    rows = [(None, "a b"), (None, "c"), (None, None), (7, "x"), (7, "y z"), (7, "x"), (1, "k")] + [(3, "same text")] * 5
    got = run(spark, rows)
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, n, c) for d, _, n, c in brute(rows, library) if d is not None)
    assert [d for d, *_ in got] == [r[0] for r in brute(rows, library)]
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    assert sorted(c for d, _, _, c in got if d is None) == sorted(c for d, _, _, c in brute(rows, library) if d is None)


def test_empty_table(spark):
    assert run(spark, []) == []


def encoded(encoder, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return encoder.encode(data, np.cumsum([0] + [len(t.encode()) for t in texts]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r \x0b\x1c\x85'abstrelvmd1²!.é×÷ſǅ中<|>\u3000\u200b")), st.integers(0, 0x10FFFF).map(lambda c: chr(c) if not 0xD800 <= c < 0xE000 else "a")), max_size=60))
def test_cuts_change_nothing(text):
    encoder = test_cuts_change_nothing.__dict__.setdefault("encoder", op.Encoder(PATH))
    ids, counts = encoded(encoder, [text, "", text])
    want = encoder.model.encode(text, add_special_tokens=False).ids + [0]
    assert ids.tolist() == want + [0] + want and counts.tolist() == [len(want), 1, len(want)]


def test_latin_letters_and_pairs(library):
    """ASCII and the edges of the Latin letters before and after characters of each kind."""
    encoder = op.Encoder(PATH)
    texts = [a + chr(c) + b for c in [*range(0x80), 0x85, 0xA0, 0xAA, 0xC0, 0xD7, 0xD8, 0xF7, 0xFF, 0x100, 0x1BB, 0x24F] for a in ("a", "1", " ", "!", "'", "\n", "é") for b in ("s", "2", " x", "?", "'s", "\n\n")]
    ids, counts = encoded(encoder, texts)
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgetting_pieces(monkeypatch):
    encoder = op.Encoder(PATH)
    first = encoded(encoder, ["one two three"])[0].tolist()
    monkeypatch.setattr(op, "PIECES", 1)
    assert encoded(encoder, ["four five"])[0].tolist()[-1] == 0 and encoded(encoder, ["one two three"])[0].tolist() == first


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2 ** 32])
def test_round_trip_and_ranges(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = top - 1  # outliers
    if n > 2000:
        ids[100:1200] = min(7, top - 1)
    raw = op.file_bytes(ids, [None, -3], [n, 0])
    f = op.TokenFile(io.BytesIO(raw))
    assert f.doc_ids == [None, -3] and f.counts.tolist() == [n, 0] and (f.read_ids(0, n) == ids).all()
    for a, b in [(0, 0), (0, min(n, 3)), (n // 2, n), (min(1000, n), min(1030, n)), (max(n - 1, 0), n)]:
        assert (f.read_ids(a, b) == ids[a:b]).all()


def test_blocks_are_patched():
    """The width follows the percentile, outliers are exceptions, and few bytes are used."""
    x = np.arange(1024, dtype=np.uint32) % 16 + 40_000
    x[[5, 600]] = 4_000_000_000
    block = op.pack_blocks(x[None])[0]
    least, width, exceptions = struct.unpack_from(op.BLOCK_HEADER, block)
    assert (least, width, exceptions) == (40_000, 4, 2) and len(block) == struct.calcsize(op.BLOCK_HEADER) + 512 + 2 * 6
    assert (op.unpack_blocks([block], 1024)[0] == x).all()


def test_only_needed_blocks_are_read():
    ids = np.arange(50 * 1024, dtype=np.uint32)
    raw = op.file_bytes(ids, [1], [len(ids)])

    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            Counted.total += n
            return super().read(n)

    f = op.TokenFile(Counted(raw))
    before = Counted.total
    assert (f.read_ids(30_000, 30_010) == ids[30_000:30_010]).all()
    assert Counted.total - before < len(raw) // 20
