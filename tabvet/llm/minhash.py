"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import few, join_groups, one_row_per_text, outer_id, salted_join, sliced, with_ids
from .links import components, joined
from .words import mix, word_hashes

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: With so many pairs between components left for each document in a bucket, stars end.
PAIRS_PER_DOC = 8
#: Members of a bucket that are paired with as many others in one task.
BLOCK = 512
_EMPTY = np.uint64(2**64 - 1)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Many intermediate tables stand at once: packed tighter than by default."""
    return common.stored(df, name, "zstd", rows)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, letters A-Z lower-cased.

    A text of fewer than ``k`` words has its whole sequence as one shingle, a text
    without words none.
    """
    hashes, ends = word_hashes([t.lower() for t in texts])
    weights = mix(np.arange(1, k + 1, dtype=np.uint64))
    n = len(hashes)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if len(full) else 0):
        full += hashes[j : j + len(full)] * weights[j]
    full = mix(full)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= k:
            out.append(np.unique(full[start : end - k + 1]))
        elif end > start:
            out.append(mix((hashes[start:end] * weights[: end - start]).sum(keepdims=True) + np.uint64(end - start)))
        else:
            out.append(np.empty(0, np.uint64))
        start = end
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS): the least hash in each bin; an empty bin takes the value of the
    first filled bin in an order that its own hash function gives (the same for all)."""
    sig = np.full((len(sets), BINS), _EMPTY)
    for i, s in enumerate(sets):
        if len(s):
            b = (s >> np.uint64(57)).astype(np.intp)
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            sig[i, b[first]] = s[first]
    source = sig.copy()
    open_rows = np.flatnonzero((sig == _EMPTY).any(axis=1) & (source != _EMPTY).any(axis=1))
    bins, turn = np.arange(BINS, dtype=np.uint64), 0
    while len(open_rows):
        turn += 1
        donor = (mix(bins * np.uint64(1_000_003) + np.uint64(turn)) % np.uint64(BINS)).astype(np.intp)
        got = sig[open_rows]
        got = np.where(got == _EMPTY, source[open_rows][:, donor], got)
        sig[open_rows] = got
        open_rows = open_rows[(got == _EMPTY).any(axis=1)]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys; the band is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    return mix((parts * _K).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def _sketch(k: int):
    def sketch(batches):
        import pyarrow as pa

        for b in sliced(batches):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            keys = band_keys(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(keys.ravel()))],
                names=["_id", "n", "digest", "keys"],
            )

    return sketch


def _sets(k: int):
    def sets(batches):
        import pyarrow as pa

        for b in sliced(batches):
            found = shingle_sets(b.column(1).to_pylist(), k)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            flat = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["_id", "set"])

    return sets


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: components of documents whose shingle
    sets have a Jaccard similarity of at least ``percent`` / 100.

    Documents with the same set are one class from the start.  Classes that share
    a bucket are candidates; 32 bands of 4 leave a pair at 0.8 apart in all of them
    with probability 5e-8.  In each bucket the class with the fullest buckets is the
    centre of a star and is checked against all others on full sets, so candidates
    are as many as bucket members and never all pairs; then it leaves the bucket.
    What the star cannot settle are pairs of one bucket that are still in different
    components.  Shingles that only one of their sets holds are in no intersection;
    a set with too few others can have no link and leaves too.  Stars go on while each
    leaves less than half of the pairs.  When they do not, or few are left (PAIRS_PER_DOC), each
    pair is taken up in its first common bucket, and those that their distances to the
    centres do not rule out are checked.  So the star loses no link.  Of buckets with the
    same members one is taken; large buckets are paired in blocks.

    Null and empty texts, and texts without words, have an empty set and stay alone;
    rows equal in id (null is an id) and text are one document, others that repeat an
    id are documents of their own; an empty table gives an empty result; other columns are not read.
    """
    rows, ids = one_row_per_text(docs, id_col, text_col)
    rows = rows.select("_id", F.col("_text").cast("binary").alias("body"))
    sketches = stored(rows.mapInArrow(_sketch(shingle), "_id long, n long, digest binary, keys array<long>"), "sketches")
    filled = sketches.where("n > 0")
    classes = stored(filled.groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    placed = classes.select("rep", "n", F.explode("keys").alias("key"))
    same = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("rep").alias("lo"), F.max("rep").alias("hi")]
    buckets = placed.groupBy("key").agg(F.count("*").alias("members"), *same).where("members > 1")
    buckets = stored(buckets.groupBy("members", "x", "y", "lo", "hi").agg(F.min("key").alias("key")).select("key", "members"), "buckets")
    n_placed = classes.count() * BANDS
    open_members = stored(join_groups(placed, buckets, ["key"], "members", n_placed).select("key", "rep", "n", "members"), "members")
    n_in_buckets = open_members.count()
    in_bucket = stored(open_members.select(F.col("rep").alias("_id")).distinct(), "open", n_in_buckets)
    sets = stored(rows.join(few(in_bucket), "_id", "left_semi").mapInArrow(_sets(shingle), "_id long, set array<long>"), "sets")
    n_open = sets.count()
    labels, sims = None, None

    def check(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distance and link of ``pairs(a, b)`` on full sets, with the earlier results, and the new links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if sims is not None:
            pairs = pairs.join(sims, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        one = sets.select(F.col("_id").alias("a"), F.col("set").alias("sa")).join(few(pairs), "a")
        two = one.join(sets.select(F.col("_id").alias("b"), F.col("set").alias("sb")), "b")
        shared = two.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("total"))
        union = F.col("total") - F.col("i")
        new = stored(shared.select("a", "b", F.struct((1 - F.col("i") / union).alias("d"), F.col("i").cast("long").alias("i")).alias("to"), (F.col("i") * 100 >= union * percent).alias("link")), "sims")
        return new if sims is None else sims.unionByName(new), new.where("link").select("a", "b")

    def fits(a: str, b: str):
        """Sets of these sizes can be similar enough."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def reaches(own, n, other):
        """``own`` shared shingles are enough for a link of sets of ``n`` and ``other``."""
        return own * (100 + percent) >= (n + other) * percent

    def able(rows: DataFrame, used: DataFrame, own: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """``rows`` with ``own``, the shingles of a set that another set of ``rows`` or of
        ``used`` holds too, less those that can have no link with even the smallest set
        of their bucket.  ``own`` is counted after the first star and holds from then on, as
        later stars have fewer sets."""
        if own is None:
            holders = rows.select(F.col("rep").alias("_id")).union(used).distinct()
            held = sets.join(holders, "_id", "left_semi").select("_id", F.explode("set").alias("s"))
            single = held.groupBy("s").agg(F.count("*").alias("c"), F.min("_id").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("single"))
            counted = rows.select("rep", "n").distinct().join(single, "rep", "left")
            own = stored(counted.select("rep", (F.col("n") - F.coalesce("single", F.lit(0))).alias("own")), "own")
        rows = rows.join(few(own), "rep")
        return own, stored(rows.where(reaches(F.col("own"), F.col("n"), F.greatest("least", F.col("n") * percent / 100))).drop("least"), "able")

    def between(rows: DataFrame) -> DataFrame:
        """Those of ``rows`` whose bucket holds more than one component, with its smallest set."""
        labels_in = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held"), F.min("n").alias("least"))
        labels_in = stored(labels_in.where("lo < hi").select("key", "held", "least"), "mixed", n_members)
        n_rows = labels_in.agg(F.sum("held")).first()[0] or 0
        return stored(join_groups(rows, labels_in, ["key"], "held", n_rows).drop("held"), "between")

    def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides of a join of all members of a bucket, BLOCK by BLOCK."""
        parts = stored(rows.groupBy("key").agg(F.count("*").alias("held")), "parts", n_members)
        n_rows = parts.agg(F.sum("held")).first()[0] or 0
        own = join_groups(rows, parts, ["key"], "held", n_rows).withColumn("parts", F.ceil(F.col("held") / BLOCK)).withColumn("own_part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        left = own.withColumn("right_part", every).withColumnRenamed("own_part", "left_part")
        right = own.withColumn("left_part", every).withColumnRenamed("own_part", "right_part")
        return left.drop("held", "parts"), right.drop("held", "parts")

    crowds = open_members.groupBy("rep").agg(F.sum("members").alias("crowd"))
    open_members = open_members.drop("members").join(crowds, "rep").withColumn("to", F.array().cast("array<struct<d:double,i:bigint>>"))
    own, before, n_members = None, None, n_in_buckets
    while n_open:
        centres = stored(open_members.groupBy("key").agg(F.max(F.struct("crowd", F.xxhash64("rep").alias("h"), "rep", "n")).alias("c"), F.count("*").alias("members"))
                         .select("key", "members", F.col("c.rep").alias("c"), F.col("c.n").alias("nc")), "centres", n_members)
        total = n_members = centres.agg(F.sum("members")).first()[0] or 0
        star = join_groups(open_members, centres, ["key"], "members", total).where(F.col("rep") != F.col("c"))
        sims, links = check(star.where(fits("n", "nc")).select(F.col("rep").alias("a"), F.col("c").alias("b")))
        labels = components(links) if labels is None else joined(labels, links)
        known = star.withColumnRenamed("to", "before").join(sims.select("a", "b", "to"), (F.least("rep", "c") == F.col("a")) & (F.greatest("rep", "c") == F.col("b")), "left")
        known = known.select("key", "rep", "n", "crowd", F.concat("before", F.array("to")).alias("to"))
        named = stored(known.join(few(labels), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
        own, still = able(between(named), centres.select(F.col("c").alias("_id")), own)
        pairs = still.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.expr("(sum(c) * sum(c) - sum(c * c)) / 2").cast("long").alias("pairs"))
        left = pairs.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        if left <= PAIRS_PER_DOC * n_open or before is not None and 2 * left > before:
            in_open = still.groupBy("rep").agg(F.collect_set("key").alias("open"))  # BANDS at most
            one, other = blocks(still.join(in_open, "rep"))
            other = other.select("key", "left_part", "right_part", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("own").alias("ob"), F.col("to").alias("tb"), F.col("open").alias("open_b"))

            def rules_out(x, y):
                """A centre at ``x`` and ``y`` from two sets shows that they are not similar:
                1 - Jaccard is a metric, so two that are close are about as far from it;
                what they share is in it or, outside it, among what others hold too."""
                common = F.least(x["i"], y["i"]) + F.least(F.col("own") - x["i"], F.col("ob") - y["i"])
                return (F.abs(x["d"] - y["d"]) > 1 - percent / 100 + 1e-9) | ~reaches(common, F.col("n"), F.col("nb"))

            apart = F.exists(F.zip_with("to", "tb", rules_out), lambda x: x)
            first = F.array_min(F.array_intersect("open", "open_b")) == F.col("key")
            possible = fits("n", "nb") & reaches(F.least("own", "ob"), F.col("n"), F.col("nb")) & ~F.coalesce(apart, F.lit(False))
            both = one.withColumnRenamed("rep", "a").join(other, ["key", "left_part", "right_part"]).where((F.col("label") < F.col("lb")) & possible & first)
            labels = joined(labels, check(both.select("a", "b"))[1])
            break
        open_members, before = still.select("key", "rep", "n", "crowd", "to"), left

    of_class = classes.select("digest", "size", "rep")
    if labels is None:
        of_class = of_class.withColumn("label", F.col("rep"))
    else:
        of_class = of_class.join(few(labels), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    n_filled = classes.agg(F.sum("size")).first()[0] or 0
    grouped = salted_join(filled.select("_id", "n", "digest"), of_class.select("digest", "size", "label"), ["digest"], "size", n_filled)
    alone = sketches.where("n = 0").select("_id", "n", F.col("_id").alias("label"))
    out = grouped.select("_id", "n", "label").unionByName(alone)
    if ids is None:
        out = out.withColumn("component_id", outer_id("label"))
    else:
        out = stored(out, "components")
        sizes = with_ids(out.groupBy("label").agg(F.count("*").alias("size")), ids, "label", "component_id")
        out = salted_join(out, sizes, ["label"], "size", out.count())
    return with_ids(out, ids).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("_id") == F.col("label")).alias("kept"))
