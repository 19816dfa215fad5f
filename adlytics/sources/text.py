"""Delimited-text sources and sinks (S-4 .. S-7).

* :func:`read_report` reads an ad-console export: UTF-16, tab separated,
  free-text preamble lines before the header; a file is one task.
* :func:`read_report_split` reads the same with many tasks a file.
* :func:`write_tsv` writes a tab-separated file set with header.
* :func:`transcode_report` is read + write: a batch re-encoding job.
* :func:`cached` is the "query or reload from disk" helper: a result is
  written once as parquet under the shared checkpoint folder and read back.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from adlytics.session import ensure_checkpoint_dir

REPORT_COLUMNS = ["Search term", "Impr.", "Clicks", "CR", "ROAS", "Bookings", "Revenue"]
REPORT_NAMES = ["search_term", "impr", "clicks", "cr", "roas", "bookings", "revenue"]


def read_report(spark: SparkSession, path: str, header_first: str = "Search term",
                encoding: str = "UTF-16", sep: str = "\t") -> DataFrame:
    """Rows after the header line of each file, all columns as strings
    (named as ``REPORT_NAMES``).

    The preamble is what stands before the first header line of a file, by
    position.  A line with fewer fields keeps what it has, the rest is NULL; an
    empty field is NULL; only a line with too many fields is left out.  A file
    without a header line is an error.

    Each file is read whole by one task (UTF-16 cannot be split at bytes); many
    files are read in parallel.  Quotes have no meaning in these exports.
    """
    n = len(REPORT_NAMES)
    files = (spark.read.format("binaryFile").load(path)
             .select("path", F.decode("content", encoding).alias("body")))
    lines = F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n")
    files = files.select("path", F.transform(lines, lambda x: F.split(x, sep, -1)).alias("lines"))
    first = F.array_position(F.transform("lines", lambda x: F.element_at(x, 1) == header_first), F.lit(True)).cast("int")
    missing = F.raise_error(F.concat(F.lit("no header line in "), "path"))
    files = files.withColumn("_head", F.when(first > 0, first).otherwise(missing.cast("int")))
    rows = files.select(F.explode(F.slice("lines", F.col("_head") + 1, F.size("lines"))).alias("f"))
    # the text after the last line end is no line
    rows = rows.filter((F.size("f") <= n) & ~((F.size("f") == 1) & (F.element_at("f", 1) == "")))
    return rows.select(*[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(REPORT_NAMES)])


def _aligned(pieces: DataFrame, line_end: bytes) -> DataFrame:
    """Whole lines of the pieces (path, block, id, bytes) of files in which bytes
    that only look like a line end occur.

    Such a place stands across two code units, so the pieces on its two sides have odd
    lengths: a piece starts a line if the number of odd pieces before it is even.
    That number is counted inside a block and, from one row a block, over the blocks
    of a file, so no window holds more than a block's rows.  The pieces
    of a line, which may lie in two blocks, are then put together."""
    block, odd = ["path", "block"], F.length("bytes") % 2
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (pieces.groupBy(*block).agg(F.sum(odd).alias("_n"))
              .select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")))
    upto = Window.partitionBy(*block).orderBy("id")
    p = pieces.withColumn("_in", F.coalesce(F.sum(odd).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.when((F.col("_n0") + F.col("_in")) % 2 == 0, F.struct("block", "id"))
    p = p.join(blocks, block).withColumn("_start", start)
    p = p.withColumn("_start", F.max("_start").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    last = (p.groupBy(*block).agg(F.max("_start").alias("_last"))
            .select(*block, F.max("_last").over(before).alias("_open")))
    p = p.join(last, block).withColumn("_start", F.coalesce("_start", "_open"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "bytes")))
    whole = F.aggregate(F.transform(parts, lambda x: x["bytes"]), F.lit(None).cast("binary"),
                        lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.lit(line_end), x)))
    return (p.groupBy("path", "_start").agg(whole.alias("bytes"))
             .select("path", F.col("_start.block").alias("block"), F.col("_start.id").alias("id"), "bytes"))


def read_report_split(spark: SparkSession, path: str, header_first: str = "Search term",
                      encoding: str = "UTF-16LE", sep: str = "\t") -> DataFrame:
    """The rows of :func:`read_report`, a large file being read by many tasks.

    The line reader cuts the bytes at the encoded line feed, so a file is dealt
    out in ranges of ``spark.sql.files.maxPartitionBytes``.  A line's place is (block
    start, row number in its task); one aggregate finds each file's first
    header line, and only what stands behind it is kept.  Two neighbouring code
    units can hold the bytes of a line feed across their border; files in which that
    happens have pieces of odd length and go through :func:`_aligned`.

    ``encoding`` names the byte order (UTF-16LE or UTF-16BE; a byte order mark is
    passed over).  Lines end with LF or CR LF.  A file without a header line is an
    error, also if it is in another byte order; a file of no bytes has no rows."""
    line_end = "\n".encode(encoding)
    raw = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("bytes"))

    def is_header(b: Column) -> Column:
        name = [F.lit((mark + header_first).encode(encoding)) for mark in ("", "\ufeff")]
        after = [F.lit(x.encode(encoding)) for x in (sep, "\r")]
        return reduce(or_, [(b == n) | F.startswith(b, F.concat(n, a)) for n in name for a in after])

    def head(lines: DataFrame, *more: Column) -> DataFrame:
        at = F.min(F.when(is_header(F.col("bytes")), F.struct("block", "id")))
        return lines.groupBy("path").agg(at.alias("_head"), *more)

    files = head(pieces, F.max(F.length("bytes") % 2).alias("_odd")).checkpoint()      # a row a file
    lines = pieces.join(files.filter("_odd = 0"), "path")
    if not files.filter("_odd = 1").isEmpty():
        mended = _aligned(pieces.join(files.filter("_odd = 1"), "path", "left_semi"), line_end)
        lines = lines.drop("_odd").unionByName(mended.join(head(mended), "path"))
    missing = F.raise_error(F.concat(F.lit("no header line in "), "path"))
    lines = lines.filter(F.when(F.col("_head").isNull(), missing.cast("boolean"))
                         .otherwise(F.struct("block", "id") > F.col("_head")))
    f = F.split(F.regexp_replace(F.decode("bytes", encoding), "\r$", ""), sep, -1)
    n = len(REPORT_NAMES)
    rows = lines.select(f.alias("f")).filter((F.size("f") <= n) & ~((F.size("f") == 1) & (F.element_at("f", 1) == "")))
    return rows.select(*[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(REPORT_NAMES)])


def write_tsv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Tab-separated text with header (no index column), blanks and quotes as they are."""
    (df.write.mode("overwrite").option("sep", "\t").option("header", True).option("encoding", encoding)
       .option("quote", "").option("escapeQuotes", False).option("emptyValue", "")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_tsv` wrote in UTF-8, all columns as strings."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def transcode_report(spark: SparkSession, src: str, dst: str, encoding: str = "UTF-16LE") -> int:
    """UTF-16 report -> UTF-8 tab file without the preamble; returns the rows
    written, counted while they are written."""
    written = Observation()
    write_tsv(read_report_split(spark, src, encoding=encoding).observe(written, F.count(F.lit(1)).alias("rows")), dst)
    return written.get["rows"]


def cached(spark: SparkSession, name: str, build, source: str = "", params: dict | None = None,
           reload: bool = True) -> DataFrame:
    """Load a result from the shared folder if it is complete there (and
    ``reload``), else build it, write it there as parquet and read it back.

    The key is the name with the data folder ``source`` and ``params``, so another
    folder or parameter set never gets the old result.  Presence is asked of
    the folder's own file system.  The write cuts the lineage."""
    key = hashlib.sha256(json.dumps([name, source, params or {}], sort_keys=True, default=str).encode()).hexdigest()[:16]
    base = f"{ensure_checkpoint_dir(spark)}/adlytics-cache/{name}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(base + "/_SUCCESS")
    if not (reload and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)):
        build().write.mode("overwrite").parquet(base)
    return spark.read.parquet(base)
