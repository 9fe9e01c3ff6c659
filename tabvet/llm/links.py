"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, stored


def components(links: DataFrame) -> DataFrame:
    """``rep, label`` of every end of ``links(a, b)``: the smallest id that it reaches.

    Each round takes the least label among an end, which is its own neighbour, and the others, and
    then the label's own label, so long chains halve; stars, as the candidates are, take two rounds.
    Labels are broadcast while their counted rows are few.  Beyond that both joins read tables that
    are written and shuffled for them alone, so that Spark can split the rows of an end with many
    links, or of a label of many ends, over tasks.
    """
    ends = links.select(F.explode(F.array(*[F.struct(F.col(x).alias("rep"), F.col(y).alias("to")) for x, y in ("ab", "ba", "aa", "bb")])).alias("e")).select("e.*")
    ends = stored(ends.distinct(), "ends", rows=4 * links.count())
    n = ends.count()
    labels = stored(ends.groupBy("rep").agg(F.min("to").alias("label")), "labels", rows=n)
    while True:
        known = few(labels)
        near = ends.join(known.select(F.col("rep").alias("to"), "label"), "to")
        step = near.groupBy("rep").agg(F.max(F.when(F.col("to") == F.col("rep"), F.col("label"))).alias("old"), F.min("label").alias("label"))
        own = known.select(F.col("rep").alias("label"), F.col("label").alias("above"))
        step = stored(step.join(own, "label", "left").select("rep", "old", F.coalesce("above", "label").alias("label")), "labels", rows=n)
        labels = step.select("rep", "label")
        if step.where("label <> old").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, label`` after more ``links(a, b)``, from the written ``labels`` of those before.

    A component stands as one end, so links inside it take no part any more, and many links
    between two components are one.  An end that had no link before is its own component.
    """
    for x in "ab":
        own = few(labels).select(F.col("rep").alias(x), F.col("label").alias("_label"))
        links = links.join(own, x, "left").withColumn(x, F.coalesce("_label", x)).drop("_label")
    above = components(stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "joined"))
    known = few(above).select(F.col("rep").alias("label"), F.col("label").alias("above"))
    old = labels.join(known, "label", "left").select("rep", F.coalesce("above", "label").alias("label"))
    return stored(old.unionByName(above.join(few(labels), "rep", "left_anti")), "labels", rows=labels.count() + above.count())
