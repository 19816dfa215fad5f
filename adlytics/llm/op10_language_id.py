"""Language identification by character language models.

One interpolated Kneser-Ney model of order ORDER per language.  Texts become
lower-case letters and single blanks.  The models share one layout: for every
order a sorted array of 64-bit gram hashes with the interpolated log
probability of the gram under each language, and a sorted array of context
hashes with the languages' back-off weights.  A text's score per language is
its cross-entropy divided by its length; the lowest wins, ties go to the
language first by code point.

Fitting uses a bounded sample of labelled rows: about FIT_CHARS code points in
all, shared evenly by the languages, whole texts chosen by a hash of doc_id
(at least about FIT_ROWS rows of each language).  One row in five of the sample
is left out of the counts and calibrates the rejection: a text is rejected if
its cross-entropy lies further above its language's mean than nearly all of
the calibration texts do, allowing for its length.

Texts that are null or have no letter are ``und`` with score 0 and rejected.
Without any labelled row every text is.  Rows are independent; repeated rows
get equal results, a null doc_id is hashed as the empty text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import load, mix64, share, shared_value, text_blocks

ORDER = 5
FIT_CHARS = 8_000_000
FIT_ROWS = 200
UNKNOWN = "und"
BLANK = 32
SHORT = 400   # spread of the cross-entropy shrinks with length up to here


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, a blank for all else."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, letters): each text as letters and single blanks with
    ORDER - 1 blanks before it; bounds of its own symbols; letters per text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, offsets)
    s = table[points]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    blank = s == BLANK
    keep = ~blank
    if len(s):
        keep[1:] |= ~blank[:-1] & (text[1:] == text[:-1])  # the blank after a letter stays
    s, text = s[keep], text[keep]
    n = np.bincount(text, minlength=len(offsets) - 1)
    letters = np.bincount(text[s != BLANK], minlength=len(offsets) - 1)
    pad = ORDER - 1
    ends = np.cumsum(n + pad)
    out = np.full(int(ends[-1]) if len(ends) else 0, BLANK, np.uint32)
    out[np.arange(len(s)) + pad * (text + 1)] = s
    return out, np.stack([ends - n, ends], axis=1), letters


def gram_hashes(symbols: np.ndarray, where: np.ndarray, length: int, back: int = 0) -> np.ndarray:
    """Hash of the ``length`` symbols that end ``back`` before each position."""
    h = np.full(len(where), length, np.uint64)
    for j in range(length - 1 + back, back - 1, -1):
        h = (h + symbols[where - j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


def _row_hashes(codes: np.ndarray) -> np.ndarray:
    """As ``gram_hashes`` for rows of symbols."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for j in range(codes.shape[1]):
        h = (h + codes[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


@dataclass
class SortedHashes:
    """Sorted 64-bit keys with a row of values each."""
    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.bits = max(1, int(len(self.keys)).bit_length())
        top = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys, top).astype(np.int64)
        self.guarded = np.concatenate([self.keys, [np.uint64(2 ** 64 - 1)]])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        got = self.guarded[at]
        low = np.flatnonzero(got < h)
        while len(low):
            at[low] += 1
            got[low] = self.guarded[at[low]]
            low = low[got[low] < h[low]]
        at[(got != h) | (at == len(self.keys))] = -1
        return at


@dataclass
class Models:
    languages: list[str]
    grams: list[SortedHashes]     # by order, from 1
    backoff: list[SortedHashes]   # of contexts of length order - 1
    unseen: float                 # log probability of an unknown symbol
    mean: np.ndarray = None
    limit: np.ndarray = None

    def log_probs(self, symbols: np.ndarray, where: np.ndarray) -> np.ndarray:
        out = np.zeros((len(where), len(self.languages)), np.float32)
        left = np.arange(len(where))
        for k in range(ORDER, 0, -1):
            pos = where[left]
            row = self.grams[k - 1].find(gram_hashes(symbols, pos, k))
            hit = row >= 0
            out[left[hit]] += self.grams[k - 1].values[row[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:
                row = self.backoff[k - 1].find(gram_hashes(symbols, where[left], k - 1, back=1))
                known = row >= 0
                out[left[known]] += self.backoff[k - 1].values[row[known]]
        out[left] += np.float32(self.unseen)
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropies in nats per symbol, symbols and letters."""
        symbols, bounds, letters = symbols_of(data, offsets, table)
        n = bounds[:, 1] - bounds[:, 0]
        own = np.ones(len(symbols), bool)
        for j in range(1, ORDER):
            own[bounds[:, 0] - j] = False
        logs = self.log_probs(symbols, np.flatnonzero(own))
        total = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n)])[some]
            total[some] = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letters


def fit_models(languages: list[str], language: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Models:
    """Interpolated Kneser-Ney from the counts of the highest order; lower
    orders count the different symbols seen before a gram."""
    n_lang = len(languages)
    vocabulary = len(np.unique(codes)) + 1
    levels = {}
    grams, c = codes, None
    for k in range(ORDER, 0, -1):
        h = _row_hashes(grams)
        keys, first, row = np.unique(h, return_index=True, return_inverse=True)
        table = np.zeros((len(keys), n_lang))
        if k == ORDER:
            np.add.at(table, (row, language), counts)
        else:  # continuation counts
            np.add.at(table, row, (c > 0).astype(np.float64))
        uniq = grams[first]
        levels[k] = (keys, uniq, table)
        grams, c = uniq[:, 1:], table
    found_grams, found_backoff = [None] * ORDER, [None] * ORDER
    below = np.full((1, n_lang), 1.0 / vocabulary)
    for k in range(1, ORDER + 1):
        keys, uniq, table = levels[k]
        ctx_keys, ctx = np.unique(_row_hashes(uniq[:, :-1]), return_inverse=True)
        total, types = np.zeros((len(ctx_keys), n_lang)), np.zeros((len(ctx_keys), n_lang))
        np.add.at(total, ctx, table)
        np.add.at(types, ctx, (table > 0).astype(np.float64))
        once, twice = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.clip(np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5), 0.1, 0.9)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        suffix = np.searchsorted(levels[k - 1][0], _row_hashes(uniq[:, 1:])) if k > 1 else np.zeros(len(uniq), np.int64)
        own = np.where(total[ctx] > 0, np.maximum(table - discount, 0) / np.maximum(total[ctx], 1), 0.0)
        prob = own + weight[ctx] * below[suffix]
        found_grams[k - 1] = SortedHashes(keys, np.log(prob).astype(np.float32))
        found_backoff[k - 1] = SortedHashes(ctx_keys, np.log(weight).astype(np.float32))
        below = prob
    unseen = found_backoff[0].values[0] + np.log(1.0 / vocabulary)
    return Models(languages, found_grams, found_backoff, unseen)


def _count_grams(table, batches):
    """language, fit flag, the ORDER symbols of each distinct gram, count."""
    for batch in batches:
        lang = np.array(batch.column("language").to_pylist(), np.int64)
        for first, last, data, offsets in text_blocks(batch):
            symbols, bounds, _ = symbols_of(data, offsets, table)
            n = bounds[:, 1] - bounds[:, 0]
            own = np.ones(len(symbols), bool)
            for j in range(1, ORDER):
                own[bounds[:, 0] - j] = False
            where = np.flatnonzero(own)
            of = np.repeat(lang[first:last], n)
            h = mix64(gram_hashes(symbols, where, ORDER) + of.astype(np.uint64))
            _, at, count = np.unique(h, return_index=True, return_counts=True)
            at_pos = where[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[at])] + [pa.array(symbols[at_pos - j].astype(np.int64)) for j in range(ORDER - 1, -1, -1)]
                + [pa.array(count.astype(np.int64))],
                names=["language", *[f"c{j}" for j in range(ORDER)], "n"])


def train(labelled: DataFrame, fit_chars: int = FIT_CHARS, fit_rows: int = FIT_ROWS) -> tuple[Models | None, np.ndarray]:
    """Models of the values of ``lang`` from (doc_id, text, lang) rows."""
    spark = labelled.sparkSession
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"))
    sizes = sorted(sizes.collect(), key=lambda r: r["lang"])  # one row a language
    table = letter_table()
    if not sizes:
        return None, table
    languages = [r["lang"] for r in sizes]
    # sampling rate of each language, a short literal list
    rates = [min(1.0, max(fit_chars / len(sizes) / max(r["chars"], 1), fit_rows / r["rows"])) for r in sizes]
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int")
    chance = (F.xxhash64(F.lit("language"), "doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    sample = (labelled.withColumn("language", (place - 1).cast("long"))
              .filter(chance < F.element_at(F.array(*[F.lit(x) for x in rates]), place))
              .select("text", "language", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) > 0).alias("fit")))
    grams = ", ".join(f"c{j} long" for j in range(ORDER))

    def count(rows: DataFrame):
        shared = spark.sparkContext.broadcast(table)
        out = (rows.select("text", "language")
               .mapInArrow(lambda batches: _count_grams(shared.value, batches), f"language long, {grams}, n long")
               .groupBy("language", *[f"c{j}" for j in range(ORDER)]).agg(F.sum("n").alias("n")))
        return out.toPandas().sort_values(["language", *[f"c{j}" for j in range(ORDER)]])

    got = count(sample.filter("fit"))
    if got["language"].nunique() < len(languages):  # very few rows: count all of them
        got = count(sample)
    if not len(got):
        return None, table
    models = fit_models(languages, got["language"].to_numpy(), got[[f"c{j}" for j in range(ORDER)]].to_numpy(), got["n"].to_numpy(np.float64))
    # calibration: how far above its language's mean a text's cross-entropy lies
    models.mean, models.limit = np.zeros(len(languages)), np.full(len(languages), np.inf)
    left_out = _score(sample.filter(~F.col("fit")), models, table, ()).filter("n > 0")
    means = left_out.groupBy("best").agg(F.avg("entropy").alias("m")).collect()
    for r in means:
        models.mean[r["best"]] = r["m"]
    mean = F.element_at(F.array(*[F.lit(float(x)) for x in models.mean]), F.col("best") + 1)
    z = (F.col("entropy") - mean) * F.sqrt(F.least(F.col("n"), F.lit(SHORT)))
    for r in left_out.groupBy("best").agg(F.percentile_approx(z, [0.5, 0.999], 10000).alias("q")).collect():
        models.limit[r["best"]] = r["q"][1] + 2.0 * (r["q"][1] - r["q"][0])
    return models, table


def _score(docs: DataFrame, models: Models, table: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, best (index), score, entropy, n (symbols), letters."""
    shared = share(docs.sparkSession, (models, table))

    def step(batches):
        models, table = shared_value(shared)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch):
                h, n, letters = models.entropies(data, offsets, table)
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                # posterior over a stretch of at most 40 symbols, so that it stays informative
                stretch = np.minimum(n, 40)[:, None]
                score = 1.0 / np.exp(-(h - low[:, None]) * stretch).sum(1)
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(best.astype(np.int32)), pa.array(score), pa.array(low), pa.array(n.astype(np.int64)), pa.array(letters.astype(np.int64))],
                    names=[*keep, "best", "score", "entropy", "n", "letters"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["best int, score double, entropy double, n long, letters long"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(step, schema)


def identify(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of docs with lang_pred, score, cross_entropy and rejected;
    ``labelled`` has doc_id, text and lang."""
    models, table = train(labelled)
    if models is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    scored = _score(docs, models, table, keep)
    at = F.col("best") + 1
    name = F.element_at(F.array(*[F.lit(x) for x in models.languages]), at)
    z = (F.col("entropy") - F.element_at(F.array(*[F.lit(float(x)) for x in models.mean]), at)) * F.sqrt(F.least(F.col("n"), F.lit(SHORT)))
    far = z > F.element_at(F.array(*[F.lit(float(x)) for x in models.limit]), at)
    known = F.col("letters") > 0
    return scored.select(*keep, F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(known, F.col("score")).otherwise(0.0).alias("score"),
                         F.when(known, F.col("entropy")).alias("cross_entropy"), (~known | far).alias("rejected"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labelled = docs.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), labelled)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
