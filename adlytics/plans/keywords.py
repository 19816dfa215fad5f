"""Keyword master vs paid-search terms (C-31 .. C-33)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.oracle.views import with_views
from adlytics.plans.registry import register
from adlytics.session import ensure_checkpoint_dir
from adlytics.sources import text
from adlytics.sources.views import Views

E = F.col

MARKET = "DE"
VOLUME_FROM, VOLUME_TO = "2022-11-01", "2023-11-01"
MASTER_COLS = ["object_type", "template", "keyword", "object_type_keyword", "location_id", "location_name",
               "word_form", "amenity_keyword", "prefix"]


# -------------------------------------------------------------------- C-31
def keywords_with_volume(v: Views, market: str = MARKET) -> DataFrame:
    """Non-blacklisted master keywords of a market with their 12-month
    search volume (the volume is pre-aggregated per keyword before the join)."""
    amenity = (v.keyword_volume
               .filter(E("year_month").between(F.lit(VOLUME_FROM).cast("date"), F.lit(VOLUME_TO).cast("date"))
                       & (E("market") == market))
               .groupBy("keyword").agg(F.sum("google_search_volume").alias("sv_last12m")))
    master = (v.keyword_master
              .filter((E("is_blacklisted") == "False") & (E("is_blacklisted_amenity") == "False")
                      & (E("market") == market))
              .select(*MASTER_COLS))
    return master.join(amenity, "keyword").select(*MASTER_COLS, "sv_last12m")


_MASTER_SQL = f"""
, amenity AS (
  SELECT keyword, CAST(sum(google_search_volume) AS BIGINT) AS sv_last12m FROM keyword_volume
  WHERE year_month BETWEEN DATE '{VOLUME_FROM}' AND DATE '{VOLUME_TO}' AND market = '{MARKET}' GROUP BY 1)
, master AS (
  SELECT {', '.join(MASTER_COLS)} FROM keyword_master
  WHERE is_blacklisted = 'False' AND is_blacklisted_amenity = 'False' AND market = '{MARKET}')
, with_volume AS (SELECT master.*, amenity.sv_last12m FROM master JOIN amenity USING (keyword))"""

register("c31_keywords_with_volume", oracle=with_views(_MASTER_SQL + "\nSELECT * FROM with_volume",
                                                       "keyword_volume", "keyword_master"))(keywords_with_volume)


# -------------------------------------------------------------------- C-32
def _num(c: str) -> F.Column:
    """Text with thousands separators and a ' --' NA marker to a number."""
    t = F.nullif(E(c), F.lit(" --"))
    return F.regexp_replace(t, ",", "").cast("double")


def clean_search_terms(raw: DataFrame) -> DataFrame:
    """Parse the console's text columns and aggregate the campaign rows per
    cleaned search term.  Missing impressions / clicks / bookings / revenue
    count 0; a missing CR or ROAS stays missing and is skipped by the mean
    (the original ``fillna(0)`` runs before the text parsing, N-9)."""
    parsed = raw.select(
        F.lower(F.trim(E("search_term"))).alias("search_term"),
        F.coalesce(_num("impr"), F.lit(0.0)).cast("bigint").alias("impr"),
        F.coalesce(_num("clicks"), F.lit(0.0)).cast("bigint").alias("clicks"),
        (F.regexp_replace(F.nullif(E("cr"), F.lit(" --")), "%", "").cast("double") / 100).alias("cr"),
        (F.regexp_replace(F.nullif(E("roas"), F.lit(" --")), "%", "").cast("double") / 100).alias("roas"),
        F.coalesce(_num("bookings"), F.lit(0.0)).alias("bookings"),
        F.coalesce(F.regexp_replace(F.nullif(E("revenue"), F.lit(" --")), "[€,]", "").cast("double"),
                   F.lit(0.0)).alias("revenue"))
    # pandas groupby drops a missing key (D11)
    return (parsed.filter(E("search_term").isNotNull() & (E("search_term") != ""))
            .groupBy("search_term")
            .agg(F.sum("impr").alias("impr"), F.sum("clicks").alias("clicks"), F.avg("cr").alias("cr"),
                 F.avg("roas").alias("roas"), F.sum("bookings").alias("bookings"), F.sum("revenue").alias("revenue")))


def search_terms(v: Views) -> DataFrame:
    return clean_search_terms(v.search_terms_raw)


_SEM_SQL = """
, parsed AS (
  SELECT lower(trim(search_term)) AS search_term,
         CAST(coalesce(CAST(replace(nullif(impr, ' --'), ',', '') AS DOUBLE), 0) AS BIGINT) AS impr,
         CAST(coalesce(CAST(replace(nullif(clicks, ' --'), ',', '') AS DOUBLE), 0) AS BIGINT) AS clicks,
         CAST(replace(nullif(cr, ' --'), '%', '') AS DOUBLE) / 100 AS cr,
         CAST(replace(nullif(roas, ' --'), '%', '') AS DOUBLE) / 100 AS roas,
         coalesce(CAST(replace(nullif(bookings, ' --'), ',', '') AS DOUBLE), 0) AS bookings,
         coalesce(CAST(regexp_replace(nullif(revenue, ' --'), '[€,]', '', 'g') AS DOUBLE), 0) AS revenue
  FROM search_terms_raw)
, sem AS (
  SELECT search_term, CAST(sum(impr) AS BIGINT) AS impr, CAST(sum(clicks) AS BIGINT) AS clicks, avg(cr) AS cr,
         avg(roas) AS roas, sum(bookings) AS bookings, sum(revenue) AS revenue
  FROM parsed WHERE search_term IS NOT NULL AND search_term <> '' GROUP BY 1)"""

register("c32_search_terms", floats={"cr": 6, "roas": 6, "bookings": 4, "revenue": 4},
         oracle=with_views(_SEM_SQL + "\nSELECT * FROM sem", "search_terms_raw"))(search_terms)


def _exported(v: Views, name: str) -> str:
    """The search-term rows as a UTF-16 report in a new shared folder."""
    path = f"{ensure_checkpoint_dir(v.spark)}/adlytics-reports/{name}-{uuid.uuid4().hex}"
    raw = v.search_terms_raw.select(*[E(n).alias(c) for n, c in zip(text.REPORT_NAMES, text.REPORT_COLUMNS)])
    text.write_tsv(raw, path + "/utf16", "UTF-16LE")
    return path


def search_terms_from_report(v: Views) -> DataFrame:
    """S-4, S-5: the cleaned search terms from a UTF-16 export read in byte ranges."""
    return clean_search_terms(text.read_report_split(v.spark, _exported(v, "terms") + "/utf16"))


register("c32_search_terms_report", floats={"cr": 6, "roas": 6, "bookings": 4, "revenue": 4},
         oracle=with_views(_SEM_SQL + "\nSELECT * FROM sem", "search_terms_raw"))(search_terms_from_report)


def report_transcoded(v: Views) -> DataFrame:
    """S-6, S-7: the UTF-16 export written again as UTF-8 and read back, with
    the count taken while writing."""
    path = _exported(v, "transcoded")
    n = text.transcode_report(v.spark, path + "/utf16", path + "/utf8")
    return text.read_tsv(v.spark, path + "/utf8").withColumn("rows_written", F.lit(n).cast("bigint"))


register("c32_report_transcoded", oracle=with_views(f"""
SELECT {', '.join(text.REPORT_NAMES)}, count(*) OVER () AS rows_written FROM search_terms_raw""",
    "search_terms_raw"))(report_transcoded)


# -------------------------------------------------------------------- C-33
def keyword_match(v: Views, market: str = MARKET) -> DataFrame:
    """Full outer match of cleaned master keywords with cleaned search terms,
    both keys kept (a missing side shows as NULL)."""
    h = keywords_with_volume(v, market).withColumn("keyword", F.lower(F.trim("keyword")))
    s = search_terms(v)
    return h.join(s, h.keyword == s.search_term, "full")


register("c33_keyword_match", floats={"cr": 6, "roas": 6, "bookings": 4, "revenue": 4}, oracle=with_views(
    _MASTER_SQL + _SEM_SQL + """
, h AS (SELECT * REPLACE (lower(trim(keyword)) AS keyword) FROM with_volume)
SELECT * FROM h FULL JOIN sem ON h.keyword = sem.search_term""",
    "keyword_volume", "keyword_master", "search_terms_raw"))(keyword_match)


def match_counts(v: Views, market: str = MARKET) -> DataFrame:
    """Rows of the match, rows matched on both sides, keywords without
    search data, search terms without a keyword."""
    m = keyword_match(v, market)
    return m.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(E("search_term").isNotNull() & E("keyword").isNotNull()).alias("matched"),
                 F.count_if(E("search_term").isNull()).alias("keywords_without_sem"),
                 F.count_if(E("keyword").isNull()).alias("terms_without_keyword"))


register("c33_match_counts", oracle=with_views(_MASTER_SQL + _SEM_SQL + """
, h AS (SELECT * REPLACE (lower(trim(keyword)) AS keyword) FROM with_volume)
, m AS (SELECT * FROM h FULL JOIN sem ON h.keyword = sem.search_term)
SELECT count(*) AS rows, CAST(count_if(search_term IS NOT NULL AND keyword IS NOT NULL) AS BIGINT) AS matched,
       CAST(count_if(search_term IS NULL) AS BIGINT) AS keywords_without_sem,
       CAST(count_if(keyword IS NULL) AS BIGINT) AS terms_without_keyword
FROM m""", "keyword_volume", "keyword_master", "search_terms_raw"))(match_counts)


def keywords_without_search_data(v: Views, market: str = MARKET) -> DataFrame:
    """J-11: master keywords with no search-term row (anti join)."""
    h = keywords_with_volume(v, market).withColumn("keyword", F.lower(F.trim("keyword")))
    return h.join(search_terms(v), h.keyword == E("search_term"), "left_anti")


register("c33_keywords_without_sem", oracle=with_views(_MASTER_SQL + _SEM_SQL + """
, h AS (SELECT * REPLACE (lower(trim(keyword)) AS keyword) FROM with_volume)
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM sem WHERE sem.search_term = h.keyword)""",
    "keyword_volume", "keyword_master", "search_terms_raw"))(keywords_without_search_data)
