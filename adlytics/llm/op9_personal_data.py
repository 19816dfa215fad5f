"""Personal data, in DataFrame functions only.

Base spans: email, ip, card and phone patterns, each scanned left to right
without overlaps, then checked (address parts, Luhn, digit counts).  Positions
come from splitting the text at inserted marks: code points that a text holds
itself are first replaced by another sign of the same length, which no pattern
matches, so offsets are those of the original.  Repeated groups of the patterns
are rewritten as runs of one character class over a text whose inner dots or
separators are marked; long runs then need neither recursion nor retries.

Terms: information-theoretic sanitisation.  A protected entity is the value
of a base span.  A word is a run of letters outside the base spans, of any length and
anywhere in the text.  Corpus co-occurrence gives P(entity | word) = texts with
both / texts with the word.  A word discloses an entity if at least MIN_TEXTS different
texts hold both, P(entity | word) >= MIN_SHARE and the pointwise mutual information
log2(P(entity | word) / P(entity)) is at least MIN_PART of what there is to know,
-log2 P(entity).  An entity that every text holds has nothing to disclose.  All
occurrences of such a word, in any text, become ``term`` spans and are removed like
the rest.  Different texts count, so copies do not add evidence.  Counts cover
all texts.

A null text is empty.  Rows are judged alone except for the counts; repeated rows
get equal results.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics.llm.common import checkpoint, load

KINDS = ("email", "ip", "card", "phone")
DOT, SEP, CUT, NEUTRAL = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use code points
MIN_TEXTS, MIN_SHARE, MIN_PART = 5, 0.5, 0.5
MAX_BROADCAST = 100_000
RUN = 64

LOCAL = rf"[A-Za-z0-9._%+\-{DOT}]"
# The leftmost match starts where a run of local signs starts, or where the last match ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{SEP}]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<start:bigint,end:bigint,body:string>"


def clean(text: Column) -> Column:
    """The text without the marks' own code points; offsets stay."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{DOT}-{CUT}]"), F.regexp_replace(text, f"[{DOT}-{CUT}]", NEUTRAL)).otherwise(text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside
    the functions of arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, body>> of the matches, in time linear in the
    text: starts are prefix sums over the pieces, RUN pieces at a time."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    pieces = F.split(F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{CUT}$1{CUT}")), CUT, -1)
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)

    def spans(p):
        def place(n):
            runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")),
                               lambda c: total(F.slice(n, c * RUN + 1, F.lit(RUN))))
            bases = lambda r: F.transform(r, lambda _, c: total(F.slice(r, F.lit(1), c)))

            def one(base):
                def span(j):
                    i = j * 2 + 1  # every other piece is a match
                    c = F.floor(i / RUN).cast("int")
                    start = F.get(base, c) + total(F.slice(n, c * RUN + 1, i - c * RUN))
                    return F.struct(start.alias("start"), (start + F.get(n, i)).alias("end"), F.get(p, i).alias("body"))

                return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), span)

            return let(let(runs, bases), one)

        return F.when(F.size(p) > 1, let(F.transform(p, lambda x: F.length(x).cast("long")), place).cast(f"array<{SPAN}>")).otherwise(none())

    return let(pieces, spans)


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans by kind of a cleaned text; a cheap test skips texts that
    cannot hold the kind."""
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", SEP)
    n = lambda s: F.length(digits(s["body"]))
    # empty array where the kind cannot occur
    when = lambda may, spans: F.when(may, spans).otherwise(none())
    return {
        "email": when(text.contains("@"), find(dotted, EMAIL)),
        "ip": when(text.rlike(r"[0-9]\.[0-9]"), F.filter(find(text, IP), lambda s: s["body"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))),
        "card": when(text.rlike("[0-9](?:[ -]?[0-9]){12}"),
                     F.filter(find(joined, CARD), lambda s: n(s).between(13, 19) & F.call_function("luhn_check", digits(s["body"])))),
        "phone": when(text.contains("+"), F.filter(find(text, PHONE), lambda s: n(s).between(9, 15))),
    }


def names(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def with_base(docs: DataFrame) -> DataFrame:
    """docs with one array column of spans per kind and text_key, the text's hash."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_clean", clean(F.col("text")))
    return docs.withColumns({**base_spans(F.col("_clean")), "text_key": F.xxhash64("text")}).drop("_clean")


def all_spans() -> Column:
    return reduce(lambda a, b: F.concat(a, b), [F.col(k) for k in KINDS])


def masked(text: Column) -> Column:
    """The cleaned text with every sign of a base span replaced, so that offsets stay."""
    def step(acc, s):
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        gap = F.when(s["start"] > acc["pos"], gap).otherwise(F.lit(""))
        rest = (s["end"] - F.greatest(acc["pos"], s["start"])).cast("int")
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap, F.repeat(F.lit(NEUTRAL), rest)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    spans = F.array_sort(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def forms() -> Column:
    """The different words of the text as written, base spans left out."""
    words = F.array_distinct(F.split(masked(clean(F.col("text"))), r"[^\p{L}]+"))
    return F.filter(words, lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def disclosing(docs: DataFrame) -> DataFrame | None:
    """text_key, forms: the disclosing words of a text, as written (None if there
    are none)."""
    based = with_base(docs.select("text"))
    # the outer form, since a filter on the arrays would be pushed down and compute them twice
    held = checkpoint(based.select("text_key", F.explode_outer(all_spans()).alias("s")).filter(F.col("s").isNotNull())
                      .select("text_key", F.translate(F.lower("s.body"), DOT + SEP, ".").alias("entity")).distinct())
    entity = checkpoint(held.groupBy("entity").agg(F.count("*").alias("texts")).filter(F.col("texts") >= MIN_TEXTS))
    if entity.isEmpty():
        return None
    holders = small(checkpoint(held.join(small(entity.select("entity")), "entity")
                               .groupBy("text_key").agg(F.collect_list("entity").alias("entities"))))
    # each text once, with its entities and a null that stands for any of them
    some = (based.join(holders, "text_key").select("text_key", "entities", F.array_distinct(F.transform(forms(), F.lower)).alias("terms"))
            .dropDuplicates(["text_key"]))
    rows = (some.select(F.concat("entities", F.array(F.lit(None).cast("string"))).alias("entities"), F.explode("terms").alias("term"))
            .select("term", F.explode("entities").alias("entity")))
    counts = checkpoint(rows.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= MIN_TEXTS))
    # a word stands in at least as many texts as it shares with any entity, which
    # already rules out most words
    at_least = counts.filter("entity is null").select("term", F.col("together").alias("at_least"))
    pairs = checkpoint(counts.filter("entity is not null").join(at_least, "term")
                       .filter(F.col("together") >= MIN_SHARE * F.col("at_least")).drop("at_least"))
    if pairs.isEmpty():
        return None
    wanted = small(pairs.select("term").distinct())
    copies = checkpoint(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).groupBy("text_key").agg(F.count("*").alias("copies")))
    n_texts = copies.count()
    several = small(checkpoint(copies.filter("copies > 1")))
    # a copy counts for its part of a text, so that the counts combine before the shuffle
    weight = 1.0 / F.coalesce("copies", F.lit(1))
    alone = (based.join(several, "text_key", "left").select(weight.alias("w"), F.explode(F.array_distinct(F.transform(forms(), F.lower))).alias("term"))
             .join(wanted, "term").groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("alone")))
    share = F.col("together") / F.col("alone")
    known = F.log2(F.lit(n_texts) / F.col("texts"))
    found = (pairs.join(alone, "term").join(entity, "entity")
             .filter((share >= MIN_SHARE) & (known > 0) & (F.log2(share) + known >= MIN_PART * known)).select("term").distinct())
    found = small(checkpoint(found))
    places = based.select("text_key", F.explode(forms()).alias("form")).withColumn("term", F.lower("form")).join(found, "term")
    return checkpoint(places.groupBy("text_key").agg(F.collect_set("form").alias("forms")))


def detect(docs: DataFrame) -> DataFrame:
    """docs with span arrays email, ip, card, phone and term; null text as ''."""
    docs = docs.drop(*KINDS, "term", "text_key")
    terms = disclosing(docs)
    based = with_base(docs)
    if terms is None:
        return based.withColumn("term", none()).drop("text_key")
    terms = small(terms.select(F.col("text_key").alias("_key"), F.col("forms").alias("_forms")))
    out = based.join(terms, based["text_key"] == terms["_key"], "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("_forms", "|"), F.lit(r")(?!\p{L})"))
    spans = F.when(F.col("_forms").isNotNull(), find(masked(clean(F.col("text"))), pattern)).otherwise(none())
    return out.withColumn("term", spans).drop("_key", "_forms", "text_key")


def sanitised(text: Column, kinds: tuple[str, ...] = (*KINDS, "term")) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping
    spans the first is named and the rest of the other goes with it."""
    def tagged_as(kind: str) -> Column:
        tag = F.lit(f"[{kind.upper()}]")
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("tag")))

    tagged = F.concat(*[tagged_as(k) for k in kinds])

    def step(acc, s):
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], gap, s["tag"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(tagged) > 0, F.aggregate(F.array_sort(tagged), start, step, rest)).otherwise(text)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = reduce(lambda a, b: F.concat(a, b), [names(F.col(k), k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, names(F.col("term"), "term")), ",").alias("spans"))
