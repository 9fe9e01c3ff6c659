"""The first bytes of every file (S4-S6): dialect and header without reading the files.

Files are listed by Spark (the ``binaryFile`` source with its content pruned, so nothing
but names and sizes is read) and each task opens its files and reads HEAD_BYTES of
them.  What follows are expressions over one short row a file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .dialect import detect_delimiter, detect_enclosure

#: Fixed value: bytes of a file that its dialect is judged by.
HEAD_BYTES = 10 * 1024
_BOM = "\ufeff"


def list_files(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``file, size_bytes`` of every file; contents are not read."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"))


def read_heads(files: DataFrame, n_bytes: int = HEAD_BYTES) -> DataFrame:
    """``files`` with ``head``, the first ``n_bytes`` of each file.

    For stores that pyarrow can open from their URI; :func:`tabvet.sources.dialect.file_lines`
    needs Spark's readers only, but scans.
    """

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        for b in batches:
            found = []
            for uri in b.column(0).to_pylist():
                store, path = FileSystem.from_uri(uri)
                with store.open_input_stream(path, buffer_size=0) as f:
                    found.append(f.read(n_bytes))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=["file", "size_bytes", "head"])

    return files.select("file", "size_bytes").mapInArrow(heads, "file string, size_bytes long, head binary")


def head_text(heads: DataFrame) -> DataFrame:
    """``file, size_bytes, encoding, text``: S6 judged by the head, and its whole lines.

    ``utf-8`` if the head is valid UTF-8, apart from a character that its end cuts, else
    ``latin-1``.  A line that the end cuts goes, unless it is the only one.
    """
    head, whole = F.col("head"), F.col("size_bytes") <= F.octet_length("head")
    cut = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[\xC0-\xFD][\x80-\xBF]{0,4}$", "")
    valid = F.is_valid_utf8(head.cast("string")) | (~whole & F.is_valid_utf8(F.encode(cut, "ISO-8859-1").cast("string")))
    text = F.when(F.col("encoding") == "utf-8", F.decode(F.when(F.is_valid_utf8(head.cast("string")), head).otherwise(F.encode(cut, "ISO-8859-1")), "UTF-8")).otherwise(F.decode(head, "ISO-8859-1"))
    judged = heads.withColumn("whole", whole).withColumn("encoding", F.when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1")))
    text = F.regexp_replace(text, f"^{_BOM}", "")
    complete = F.when(F.col("whole") | ~F.contains("text", F.lit("\n")), F.col("text")).otherwise(F.regexp_replace("text", r"\n[^\n]*\z", ""))
    return judged.withColumn("text", text).select("file", "size_bytes", "encoding", complete.alias("text"))


def head_lines(texts: DataFrame, max_lines: int = 6) -> DataFrame:
    """``file, line_no, line``: the first lines of each head, without their line ends."""
    lines = F.slice(F.split(F.regexp_replace("text", r"\n\z", ""), "\r?\n", -1), 1, max_lines)
    return texts.select("file", F.posexplode(lines).alias("line_no", "line"))


def _quoted_record(text: Column, q: str) -> Column:
    """The first record that is not blank; a line break between quotes belongs to it."""
    return F.regexp_extract(text, rf"^(?:[ \t\r]*\n)*+((?:[^{q}\n]++|{q}[^{q}]*+{q})*+)", 1)


def count_cells(record: Column, delimiter: Column, quote: Column) -> Column:
    """Cells of a record: delimiters outside quotes, and one."""
    plain = F.when(quote == '"', F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, r'"[^"]*+"', "")).otherwise(record))
    plain = plain.when(quote == "'", F.regexp_replace(record, r"'[^']*+'", "")).otherwise(record)
    return F.length(plain) - F.length(F.replace(plain, delimiter, F.lit(""))) + 1


def file_heads(spark: SparkSession, path, glob: str | None = None, n_bytes: int = HEAD_BYTES, quote: str | None = '"') -> DataFrame:
    """S4-S6 for every file: ``file, size_bytes, encoding, delimiter, enclosure, quote, header, columns``.

    No more than ``n_bytes`` of a file are read, whatever its size.  ``header`` is the first record
    that is not blank, read with ``quote`` (none if it is empty; each file's enclosure if it is
    None).  Files without a byte are not listed.
    """
    texts = written(head_text(read_heads(list_files(spark, path, glob), n_bytes)), "heads")
    lines = head_lines(texts)
    delimiters = detect_delimiter(lines)
    dialect = delimiters.join(detect_enclosure(lines, delimiters), "file")
    out = texts.join(dialect, "file").withColumn("quote", F.col("enclosure") if quote is None else F.lit(quote))  # one row a file on both sides
    record = F.when(F.col("quote") == "'", _quoted_record(F.col("text"), "'")).when(F.col("quote") == '"', _quoted_record(F.col("text"), '"'))
    record = F.regexp_replace(record.otherwise(F.regexp_extract("text", r"^(?:[ \t\r]*\n)*+([^\n]*+)", 1)), r"\r\z", "")
    out = out.withColumn("header", record)
    columns = F.when(F.col("header") == "", F.lit(0)).otherwise(count_cells(F.col("header"), F.col("delimiter"), F.col("quote")))
    return out.select("file", "size_bytes", "encoding", "delimiter", "enclosure", "quote", "header", columns.alias("columns"))
