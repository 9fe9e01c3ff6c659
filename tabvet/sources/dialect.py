"""Dialect profiling of many files at once.

The reference sniffs one uploaded file from its first bytes.  Here every
profile is a job over a *lines relation* ``(file, line_no, line)``, of which the first
few lines of each file take part, so a file's group is a handful of lines.
:mod:`tabvet.sources.heads` makes that relation from each file's first bytes; the
functions at the end make it, and judge encodings, by a scan of all lines, for stores
that only Spark's readers open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pystrip

# Candidate delimiters in tie-break order, candidate quotes.
DELIMITERS = [",", ";", "\t", "|"]
ENCLOSURES = ['"', "'"]
DELIMITER_LINES = 5      # header + 4 lines
ENCLOSURE_LINES = 5      # lines after the header


def _count(line: Column, d: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """``file, delimiter`` -- the delimiter met most often in the first 5
    lines; ties and all-zero counts go to the earlier candidate (comma first)."""
    head = lines.where(F.col("line_no") < DELIMITER_LINES)
    sums = head.groupBy("file").agg(*[F.sum(_count(F.col("line"), d)).alias(f"c{i}")
                                      for i, d in enumerate(DELIMITERS)])
    c = [F.col(f"c{i}") for i in range(len(DELIMITERS))]
    pick = F.when((c[0] >= c[1]) & (c[0] >= c[2]) & (c[0] >= c[3]), F.lit(DELIMITERS[0])) \
            .when((c[1] >= c[2]) & (c[1] >= c[3]), F.lit(DELIMITERS[1])) \
            .when(c[2] >= c[3], F.lit(DELIMITERS[2])) \
            .otherwise(F.lit(DELIMITERS[3]))
    return sums.select("file", pick.alias("delimiter"))


def _wrapped(field: Column, q: str) -> Column:
    return field.startswith(q) & field.endswith(q)


def detect_enclosure(lines: DataFrame, delimiters: DataFrame | None = None) -> DataFrame:
    """``file, enclosure`` by the intended scoring over the header and 5 lines.

    Header: a quote scores 10 when it wraps every field, else the wrapped
    share.  Each later non-blank line adds, per quote, the share of fields of
    length >= 2 it wraps, and for "no quote" the share wrapped by neither.
    The best score wins when above 1 (first candidate on ties), else ``"``.
    Fields are split on the file's delimiter and stripped first.
    """
    delimiters = delimiters if delimiters is not None else detect_delimiter(lines)
    head = (lines.where(F.col("line_no") <= ENCLOSURE_LINES)
                 .join(delimiters, "file")                      # one row per file
                 .withColumn("fields", F.transform(
                     F.split(F.col("line"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")), -1),
                     lambda f: pystrip(f)))
                 .withColumn("n", F.size("fields")))
    is_header = F.col("line_no") == 0
    blank = pystrip(F.col("line")) == F.lit("")
    scores = []
    for i, q in enumerate(ENCLOSURES):
        all_w = F.size(F.filter("fields", lambda f: _wrapped(f, q)))
        long_w = F.size(F.filter("fields", lambda f: (F.length(f) >= 2) & _wrapped(f, q)))
        header_score = F.when(all_w == F.col("n"), F.lit(10.0)).otherwise(all_w / F.col("n"))
        line_score = F.when(blank, F.lit(0.0)).otherwise(long_w / F.col("n"))
        scores.append(F.sum(F.when(is_header, header_score).otherwise(line_score)).alias(f"s{i}"))
    neither = F.size(F.filter("fields", lambda f: ~(_wrapped(f, '"') | _wrapped(f, "'"))))
    scores.append(F.sum(F.when(is_header | blank, F.lit(0.0))
                        .otherwise(neither / F.col("n"))).alias("s2"))
    s = [F.col("s0"), F.col("s1"), F.col("s2")]
    best = F.when((s[0] >= s[1]) & (s[0] >= s[2]), F.struct(F.lit('"').alias("q"), s[0].alias("v"))) \
            .when(s[1] >= s[2], F.struct(F.lit("'").alias("q"), s[1].alias("v"))) \
            .otherwise(F.struct(F.lit("").alias("q"), s[2].alias("v")))
    return (head.groupBy("file").agg(*scores)
                .select("file", F.when(best["v"] > 1, best["q"]).otherwise(F.lit('"')).alias("enclosure")))


def file_lines(spark: SparkSession, path: str, glob: str | None = None, max_lines: int = 6) -> DataFrame:
    """``file, line_no, line`` for the first ``max_lines`` lines of every file.

    Lines come from the text source undecoded; only each file's first split
    takes part, and within it the position is the order of reading.
    """
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    text = (r.text(path)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid"),
                     F.col("value").alias("line"))
             .where(F.col("block") == 0))
    base = text.groupBy("file", "pid").agg(F.min("mid").alias("base"))   # one row per file
    return (text.join(base, ["file", "pid"])
                .select("file", (F.col("mid") - F.col("base")).alias("line_no"), "line")
                .where(F.col("line_no") < max_lines))


def file_encodings(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, encoding`` -- ``utf-8`` when every line is valid UTF-8, else ``latin-1``.

    The whole file is checked (a partial aggregate per split), not a sample.
    """
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return (r.text(path)
             .groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
             .select("file", F.when(F.col("ok"), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding")))
