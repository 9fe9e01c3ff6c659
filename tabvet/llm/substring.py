"""Substring dedup by hashed lines or paragraphs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_per_text, salted_join, stored, with_ids

#: Units shorter than both are left alone; scripts without spaces have few words.
MIN_WORDS, MIN_CHARS = 4, 40


def normalised(unit: str) -> bytes:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    return b" ".join(unit.encode().lower().split())


def dedup_units(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_units, n_removed, kept, removed``: each repeated unit stays where it comes first.

    A text's units are its parts between ``separator`` (a line break, or two for
    paragraphs).  Units of ``min_words`` words or ``min_chars`` characters or more whose
    normalised digests are equal are the same; the one of the smallest id, then the earliest in its text,
    stays.  ``kept`` has the units that stay, with ``separator`` between them;
    ``removed`` lists start and length of the others in code points of the text.

    Digests are grouped before they are joined back, and rows of a hot digest are
    salted.  Null text counts as empty, which is one unit; rows equal in id
    (null is an id) and text are one document, others that repeat an id are documents
    of their own; an empty table gives an
    empty result; other columns are not read.
    """
    rows, outer = one_row_per_text(docs, id_col, text_col)

    def digests(batches):
        import pyarrow as pa

        for b in batches:
            ids, places, found = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, unit in enumerate(text.split(separator)):
                    n = normalised(unit)
                    if n and (n.count(b" ") + 1 >= min_words or len(n.decode()) >= min_chars):
                        ids.append(doc)
                        places.append(k)
                        found.append(hashlib.md5(n).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.binary())], names=["_id", "place", "digest"])

    def cut(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                units, gone, at = text.split(separator), set(places or ()), 0
                spans = []
                for k, unit in enumerate(units):
                    if k in gone:
                        spans.append({"start": at, "length": len(unit)})
                    at += len(unit) + len(separator)
                kept = separator.join(u for k, u in enumerate(units) if k not in gone) if gone else text
                for column, value in zip(out, (len(units), len(gone), kept, spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span)],
                names=["_id", "n_units", "n_removed", "kept", "removed"],
            )

    units = stored(rows.mapInArrow(digests, "_id long, place int, digest binary"), "units")
    first = F.min(F.struct("_id", "place"))
    repeated = stored(units.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    n = repeated.agg(F.sum("n")).first()[0] or 0
    later = salted_join(units, repeated, ["digest"], "n", n).where((F.col("_id") != F.col("first._id")) | (F.col("place") != F.col("first.place")))
    gone = later.groupBy("_id").agg(F.collect_list("place").alias("places"))  # bounded by the document
    out = rows.join(gone, "_id", "left").mapInArrow(cut, "_id long, n_units long, n_removed long, kept string, removed array<struct<start:long,length:long>>")
    return with_ids(out, outer).select("doc_id", "n_units", "n_removed", "kept", "removed")
