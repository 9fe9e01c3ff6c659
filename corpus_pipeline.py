"""A corpus pipeline of five operators; counts as part of ``tabvet.llm``.

Each stage works on what the one before kept and was written; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm import toxicity
from tabvet.llm.common import NULL_ID, few, one_document_per_text, stored, table
from tabvet.llm.decontaminate import contamination
from tabvet.llm.exact_dedup import exact_duplicates
from tabvet.llm.minhash import near_duplicates
from tabvet.llm.packing import cut, pack

#: A document scored at least this goes.
TOXIC = 0.7


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns named by place, and those of its id and text: no column can
    have the name of one that a stage adds."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = {c.lower(): n for c, n in zip(docs.columns, names)}
    return docs.toDF(*names), of["doc_id"], of["text"]


def _kept(docs: DataFrame, drop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for each id and text, less the inner keys (as ``doc_id``) that ``drop`` gives for
    ``doc_id`` (the inner key) and ``text``; all columns of ``docs``.  While the dropped keys are
    few they are broadcast, so that whole rows are neither shuffled nor sorted."""
    inner, key, text = _plain(docs)
    rows = one_document_per_text(inner, key, text)
    dropped = drop(rows.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")))
    ids = stored(dropped.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_dropped")).distinct(), "dropped")
    return rows.join(few(ids), rows["_row"] == F.col("_dropped"), "left_anti").drop("_row").toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below TOXIC; the model learns from all rows of ``labels``.

    Null and empty texts are not toxic and stay.  Repeated rows go or stay together.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    inner, key, text = _plain(docs)
    model = toxicity.train(inner.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels)
    scored = toxicity.score(inner, model, text_col=text, keep=tuple(inner.columns))
    return scored.where(F.col("score") < TOXIC).select(*inner.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts; rows equal in id and text are one before."""
    return _kept(docs, lambda d: exact_duplicates(d).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: five-word shingles, similarity 0.8."""
    return _kept(docs, lambda d: near_duplicates(d, shingle=5, percent=80).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return _kept(docs, lambda d: contamination(d, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack(cut(docs)).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Scores, tries, MinHash and token ids are beyond SQL; tests/llm plants rows for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
