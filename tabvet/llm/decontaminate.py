"""Benchmark decontamination by template windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_row_per_text, stored, with_ids

#: Tokens of a window; a shorter item is one window as a whole.
WINDOW = 8
#: A document is contaminated by an item if it holds this share of the item's windows.
SHARE = 0.5
#: Words that stand for a unit.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
#: An item with fewer different tokens that are no placeholders is not found by its template as
#: a whole, and a window with fewer such tokens is not looked up by its template.
LEAST_LITERALS = 2
#: Item windows up to this size, estimated from their tokens, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64_000_000
#: Bytes that a token of a window takes in memory beside its characters.
_TOKEN_BYTES = 32

_TOKENS = r"[^\p{L}\p{N}]+"


def _spaced(text: Column) -> Column:
    """Runs of letters and digits, one space between."""
    return F.btrim(F.regexp_replace(text, _TOKENS, " "))


def _typed(spaced: Column) -> Column:
    """``#n`` for what starts with a digit, ``#p`` for what starts with a capital."""
    return F.regexp_replace(F.regexp_replace(spaced, r"(?<![^ ])\p{N}[^ ]*+", "#n"), r"(?<![^ ])\p{Lu}[^ ]*+", "#p")


def _form(token: Column) -> Column:
    """``#u`` for units; others in lower case."""
    return F.when(token.isin(UNITS), F.lit("#u")).otherwise(F.lower(token))


def _split(spaced: Column, words: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return _split(_spaced(text), _spaced(text))


def literal(text: Column) -> Column:
    """The same tokens in lower case."""
    return _split(_spaced(text), F.lower(_spaced(text)))


def template(text: Column) -> Column:
    """The same tokens with placeholders: ``#n`` for what starts with a digit, ``#p`` for
    what starts with a capital, ``#u`` for units; others in lower case."""
    return F.transform(_split(_spaced(text), _typed(_spaced(text))), _form)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _window_hash(hashes: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` token hashes from the 0-based place ``at``."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(size)])


def _window(words: Column, at: Column, size) -> Column:
    return F.slice(words, at + 1, size)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, share``: items of ``benchmark(item_id, text)`` that documents hold.

    Numbers, capitalised words and units become typed placeholders, so a question
    with other values keeps its template.  Windows of template tokens and windows of
    the tokens in lower case are joined by hash and then compared.  A window whose
    tokens are the same but for case matches, whatever its template.  Of the windows
    of one document and item at one distance that match by template alone, each slot
    value of the item must have one value in the document throughout.  A window of
    which more than half are placeholders says little by its template alone.  It counts
    if all windows of the item match at that distance, with one value a slot throughout
    (and the item has LEAST_LITERALS).  If not all do, but those that do agree and some
    of them are no such windows, it cannot decide and is not among the windows that
    ``share`` is taken of.  A window with fewer than LEAST_LITERALS tokens that are no
    placeholders is looked up by its tokens only, and compared by its template where
    another window of the item was found at that distance: so many capitalised words in a
    row do not meet every window of the kind.  An item that has only such windows is found
    by its tokens alone.  ``matched`` counts the item's windows that are left; pairs
    with less than ``share`` of them are not returned.

    Documents are cut to the windows that an item has before anything is shuffled.
    Null and empty texts, and items without a token, match nothing; rows equal in id
    (null is an id) and text are one, others that repeat an id are judged one by one;
    empty tables give an empty result; other columns are not read.
    """
    items, item_ids = one_row_per_text(benchmark, "item_id", "text")
    items = items.select(F.col("_id").alias("item_id"), tokens(F.col("_text")).alias("words"), template(F.col("_text")).alias("forms"))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    places = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    item_windows = stored(
        places.select("item_id", "j", "size", _window(F.col("words"), F.col("j"), F.col("size")).alias("item_words"),
                      _window(F.col("forms"), F.col("j"), F.col("size")).alias("item_forms")).withColumn("item_lower", F.transform("item_words", F.lower))
        .withColumn("sparse", F.size(F.filter("item_forms", lambda x: ~x.startswith("#"))) < LEAST_LITERALS), "items")
    letters = F.octet_length(F.array_join("item_words", "")) + F.octet_length(F.array_join("item_forms", "")) + F.octet_length(F.array_join("item_lower", ""))
    weight = item_windows.agg(F.sum(letters + 3 * _TOKEN_BYTES * F.col("size"))).first()[0] or 0
    sizes = [r["size"] for r in item_windows.select("size").distinct().collect()]  # at most ``window`` numbers

    def small(table: DataFrame) -> DataFrame:
        """One of the item tables, broadcast if it has a proven bound."""
        return F.broadcast(table) if weight <= BROADCAST_BYTES else table

    item_sizes = with_ids(items, item_ids, "item_id", "outer_item").select(
        "item_id", "outer_item", (F.size("words") - F.col("size") + 1).alias("n_windows"),
        F.size(F.array_distinct(F.filter("forms", lambda x: ~x.startswith("#")))).alias("literals"))

    rows, ids = one_row_per_text(docs, id_col, text_col)

    texts = rows.select("_id", _spaced(F.col("_text")).alias("s")).where("s <> ''")
    arrays = texts.select("_id", F.transform(F.split(_typed(F.col("s")), " "), lambda x: F.xxhash64(_form(x))).alias("forms"), _hashed(F.split(F.lower("s"), " ")).alias("lower"))
    cut, keys = None, None
    for size in sizes:
        # two rows a window, its template and its lower-cased tokens; made by the explode, so that hashing and the join stay in one compiled stage
        held = arrays.where(F.size("forms") >= size)
        each = held.select("*", F.explode(F.sequence(F.lit(0), 2 * (F.size("forms") - size) + 1)).alias("k")).withColumn("i", F.shiftright("k", 1))
        by_kind = F.when(F.col("k") % 2 == 0, _window_hash(F.col("forms"), F.col("i"), size)).otherwise(_window_hash(F.col("lower"), F.col("i"), size))
        one = each.select("_id", "i", by_kind.alias("h"))
        cut = one if cut is None else cut.unionByName(one)
        of_items = item_windows.where(F.col("size") == size).select("item_id", "j", "sparse", _hashed(F.col("item_forms")).alias("f"), _hashed(F.col("item_lower")).alias("l"))
        by_tokens, by_form = (_window_hash(F.col(c), F.lit(0), size) for c in ("l", "f"))
        looked_up = F.array_distinct(F.when(F.col("sparse"), F.array(by_tokens)).otherwise(F.array(by_tokens, by_form)))
        of_items = of_items.select(F.explode(looked_up).alias("h"), "item_id", "j")
        keys = of_items if keys is None else keys.unionByName(of_items)
    pairs = "_id long, i int, item_id long, j int"
    if cut is None:
        hits = stored(docs.sparkSession.createDataFrame([], pairs), "hits")
    else:
        hits = stored(cut.join(small(keys), "h").select("_id", "i", "item_id", "j").distinct(), "hits")
        shifts = hits.select("_id", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct()
        beside = shifts.join(small(item_windows.where("sparse").select("item_id", "j")), "item_id").select("_id", (F.col("shift") + F.col("j")).alias("i"), "item_id", "j")
        hits = hits.unionByName(beside.where("i >= 0"))

    # the tokens of the documents that matched, and of the windows
    of_doc = hits.groupBy("_id").agg(F.collect_set(F.struct("i", "item_id", "j")).alias("hits"))  # bounded by the document and the benchmark
    both = rows.join(of_doc, "_id").select("_id", literal(F.col("_text")).alias("words"), template(F.col("_text")).alias("forms"), "hits")
    each = both.select("_id", F.explode(F.transform("hits", lambda x: F.struct(
        x["i"].alias("i"), x["item_id"].alias("item_id"), x["j"].alias("j"),
        F.slice("words", x["i"] + 1, window).alias("words"), F.slice("forms", x["i"] + 1, window).alias("forms")))).alias("x")).select("_id", "x.*")
    same = each.join(small(item_windows), ["item_id", "j"]).withColumn("words", F.slice("words", 1, F.col("size"))).withColumn("forms", F.slice("forms", 1, F.col("size")))
    slots = F.filter(F.arrays_zip(F.col("item_forms").alias("f"), F.col("item_words").alias("a"), F.col("words").alias("b")), lambda s: s["f"].startswith("#"))
    same = same.withColumn("exact", F.col("words") == F.col("item_lower")).where(F.col("exact") | (F.col("forms") == F.col("item_forms")))
    same = same.withColumn("slots", F.transform(slots, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    same = same.withColumn("plain", F.col("exact") | (F.size("slots") * 2 <= F.col("size")))
    line = ["_id", "item_id", (F.col("i") - F.col("j")).alias("shift")]
    by_line = same.groupBy(*line).agg(  # bounded by the item
        F.collect_set(F.when(F.col("exact"), F.col("j"))).alias("exact"), F.collect_set(F.when(F.col("plain"), F.col("j"))).alias("plain"), F.collect_set("j").alias("js"),
        F.flatten(F.collect_set(F.when(F.col("plain"), F.col("slots")))).alias("plain_slots"), F.flatten(F.collect_set("slots")).alias("slots"))

    def steady(slots: str) -> Column:
        """Each slot of the item has one value."""
        values = F.array_distinct(slots)
        return F.size(values) == F.size(F.array_distinct(F.transform(values, lambda s: s["a"])))

    by_line = by_line.join(small(item_sizes), "item_id")
    whole = steady("slots") & (F.size("js") == F.col("n_windows")) & (F.col("literals") >= LEAST_LITERALS)
    counted = F.when(whole, F.col("js")).when(steady("plain_slots"), F.col("plain")).otherwise(F.col("exact"))
    unsure = F.when(steady("slots") & (F.size("plain") > 0), F.array_except("js", "plain")).otherwise(F.array().cast("array<int>"))
    judged = by_line.select("_id", "item_id", "outer_item", "n_windows", counted.alias("counted"), unsure.alias("unsure")).groupBy("_id", "item_id", "outer_item", "n_windows").agg(
        F.array_distinct(F.flatten(F.collect_set("counted"))).alias("counted"), F.array_distinct(F.flatten(F.collect_set("unsure"))).alias("unsure"))
    matched = judged.select("_id", "outer_item", F.size("counted").cast("long").alias("matched"), (F.col("n_windows") - F.size(F.array_except("unsure", "counted"))).alias("of"))
    part = F.col("matched") / F.col("of")
    found = matched.where("matched > 0").where(part >= share)
    return with_ids(found, ids).select("doc_id", F.col("outer_item").alias("item_id"), "matched", part.alias("share"))
