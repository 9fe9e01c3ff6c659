"""CSV files as numbered records (S1-S3, S9, P6): split files, quoted line breaks, mixed headers.

A file is read in Spark's splits of its lines, twice.  The first pass counts: each
split yields one short row with its number of quotes (odd or even) and the records
that begin in it, for either state of the quotes at its start.  A running xor over a
file's splits then tells which splits begin inside a quoted cell, and running sums give
the number of the first record of each.  The second pass cuts the lines into records;
only a record that crosses a split border is put together from pieces that are
shuffled.  So a file with line breaks in its cells is read by as many tasks as any
other, and records are numbered in file order without sorting them.
"""

from __future__ import annotations

import csv as pycsv
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .csv import CSV_GLOB
from .heads import HEAD_BYTES, count_cells, file_heads

#: The table of splits is broadcast up to this size, at some bytes a row; a larger one is joined by a shuffle.
BROADCAST_BYTES, _SPLIT_BYTES = 64_000_000, 250
#: Different headers of one scan; each is part of the plan.
MAX_HEADERS = 1000


@dataclass
class FileScan:
    """``rows``: ``row_number``, ``file`` and the columns of all headers, by name.
    ``refused``: ``file, row_number, cells, columns, record`` of records with more cells than
    their file's header.  ``files``: one row a file, the profile of S9."""

    rows: DataFrame
    refused: DataFrame
    files: DataFrame


def _fits(rows: int) -> bool:
    return rows * _SPLIT_BYTES <= BROADCAST_BYTES


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, broadcast if its rows are few."""
    return F.broadcast(table) if _fits(rows) else table


def _lines(spark: SparkSession, path, glob: str | None, files: DataFrame, n_files: int, quote: str | None) -> DataFrame:
    """``file, block, place, value, odd, blank, valid``: physical lines in their order in each
    split; ``odd``: an odd number of quotes."""
    r = spark.read.option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    text = r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    count = lambda q: (F.octet_length("value") - F.octet_length(F.replace("value", F.lit(q), F.lit("")))) % 2 == 1
    if quote is not None:
        odd = count(quote) if quote else F.lit(False)
    else:
        text = text.join(_small(files.select("file", "quote"), n_files), "file")
        text = text if _fits(n_files) else text.sortWithinPartitions("file", "place")
        odd = F.when(F.col("quote") == '"', count('"')).when(F.col("quote") == "'", count("'")).otherwise(F.lit(False))
    return text.select("file", "block", "place", "value", odd.alias("odd"), (F.btrim("value", F.lit(" \t\r")) == "").alias("blank"), F.is_valid_utf8("value").alias("valid"))


def _count_splits(batches: Iterator) -> Iterator:
    """One row a split; a split is read by one task, in order."""
    import numpy as np
    import pyarrow as pa

    names = ["h1", "h2", "block", "odd", "starts0", "starts1", "inner0", "inner1", "valid"]
    held = None  # [key, odd, starts0, starts1, inner0, inner1, valid]

    def row(x):
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x[0], *x[1:])], names=names)

    for b in batches:
        if not len(b):
            continue
        h1, h2, block, odd, blank, valid = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        edges = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
            key = (int(h1[lo]), int(h2[lo]), int(block[lo]))
            if held is None or held[0] != key:
                if held is not None:
                    yield row(held)
                held = [key, False, 0, 0, 0, 0, True]
            inside = (np.cumsum(odd[lo:hi]) - odd[lo:hi] + held[1]) % 2 == 1  # before the line, if the split begins outside
            text = ~blank[lo:hi]
            held[2] += int((~inside & text).sum())
            held[3] += int((inside & text).sum())
            held[4] += int(inside.sum())
            held[5] += int((~inside).sum())
            held[1] = bool(held[1] ^ (int(odd[lo:hi].sum()) % 2 == 1))
            held[6] = bool(held[6] and valid[lo:hi].all())
    if held is not None:
        yield row(held)


def _cut_records(batches: Iterator) -> Iterator:
    """``split, number, part, record``: whole records (part 0), and the pieces of those that cross a
    split border: 1 begins one, 2 goes on with it."""
    import numpy as np
    import pyarrow as pa

    def out(split, number, part, record):
        return pa.RecordBatch.from_arrays([pa.array(split, pa.int64()), pa.array(number, pa.int64()), pa.array(part, pa.int32()), pa.array(record, pa.binary())], names=["split", "number", "part", "record"])

    split, inside, number, pending = None, False, 0, None  # pending: [number or None, lines]

    def flush():
        """What is open when its split ends goes on in the next one."""
        return [] if pending is None else [out([split], [-1 if pending[0] is None else pending[0]], [2 if pending[0] is None else 1], [b"\n".join(pending[1])])]

    for b in batches:
        if not len(b):
            continue
        ids, opened, base, odd, blank = (c.to_numpy(zero_copy_only=False) for c in b.columns[:5])
        edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
            if ids[lo] != split:
                yield from flush()
                split, inside, number = int(ids[lo]), bool(opened[lo]), int(base[lo])
                pending = [None, []] if inside else None
            lines, quotes = b.column(5).slice(lo, hi - lo), odd[lo:hi]
            before = (np.cumsum(quotes) - quotes + inside) % 2 == 1
            starts = ~before & ~blank[lo:hi]
            inside = bool(inside ^ (int(quotes.sum()) % 2 == 1))
            after = np.append(before[1:], inside)
            numbers = number + np.cumsum(starts) - 1
            number += int(starts.sum())
            alone = starts & ~after
            if alone.any():
                yield out(np.full(int(alone.sum()), split), numbers[alone], np.zeros(int(alone.sum()), np.int32), lines.filter(pa.array(alone)))
            done: list[list] = [[], [], []]
            for i in np.flatnonzero(before | (starts & after)).tolist():
                if before[i]:
                    pending[1].append(lines[i].as_py())
                else:
                    pending = [int(numbers[i]), [lines[i].as_py()]]
                if not after[i]:
                    done[0].append(-1 if pending[0] is None else pending[0])
                    done[1].append(2 if pending[0] is None else 0)
                    done[2].append(b"\n".join(pending[1]))
                    pending = None
            if done[0]:
                yield out(np.full(len(done[0]), split), *done)
    yield from flush()


def _splits(lines: DataFrame, files: DataFrame, n_files: int) -> tuple[DataFrame, DataFrame]:
    """``file, block, odd, opened, starts, earlier`` of each split, and ``file, records, inner, valid``."""
    key = [F.xxhash64("file").alias("h1"), F.hash("file").cast("long").alias("h2")]
    counted = lines.select(*key, "block", "odd", "blank", "valid").mapInArrow(
        _count_splits, "h1 long, h2 long, block long, odd boolean, starts0 long, starts1 long, inner0 long, inner1 long, valid boolean")
    named = written(counted, "splits").join(_small(files.select("file", *key), n_files), ["h1", "h2"]).drop("h1", "h2")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    state = named.withColumn("opened", opened)
    state = state.withColumn("starts", F.when(F.col("opened"), F.col("starts1")).otherwise(F.col("starts0"))).withColumn("inner", F.when(F.col("opened"), F.col("inner1")).otherwise(F.col("inner0")))
    state = written(state.withColumn("earlier", F.coalesce(F.sum("starts").over(before), F.lit(0))).drop("starts0", "starts1", "inner0", "inner1"), "splits")
    # a file's records are those that begin in it, less its header
    per_file = state.groupBy("file").agg(F.greatest(F.sum("starts") - 1, F.lit(0)).alias("records"), F.sum("inner").alias("inner"), F.bool_and("valid").alias("valid"))
    return state, written(per_file, "counts")


def _running_offsets(per_file: DataFrame) -> DataFrame:
    """``file, offset``: data records in the files before, by path; no window holds all files."""
    spark = per_file.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(per_file.select("file", "records").repartitionByRange(n, "file").sortWithinPartitions("file")
                     .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "files")
    parts = ranged.groupBy("part").agg(F.sum("records").alias("n"))  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("records").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own", own).join(F.broadcast(parts), "part").select("file", (F.col("before") + F.col("own")).alias("offset"))


def column_names(header: str, delimiter: str, quote: str) -> list[str]:
    """Cells of a header record; an empty name is ``Unnamed: i`` and a repeated one gets ``.1``, ``.2`` ..."""
    rows = pycsv.reader([header], delimiter=delimiter, quotechar=quote or None, quoting=pycsv.QUOTE_MINIMAL if quote else pycsv.QUOTE_NONE)
    out: list[str] = []
    for i, name in enumerate(next(rows, [])):
        name, k = name or f"Unnamed: {i}", 0
        unique = name
        while unique.lower() in {x.lower() for x in out}:
            k += 1
            unique = f"{name}.{k}"
        out.append(unique)
    return out


def profile_files(spark: SparkSession, path, glob: str | None = CSV_GLOB, quote: str | None = '"') -> DataFrame:
    """``file, size_bytes, records, columns, encoding, delimiter, enclosure, line_breaks``.

    Records and columns heed the quotes; ``line_breaks`` counts the lines that go on with a cell of
    the line before.  ``encoding`` is judged by all bytes.  One pass over the lines and one read
    of each file's head.
    """
    files = written(file_heads(spark, path, glob, quote=quote), "heads")
    n_files = files.count()
    return _profile(files, _splits(_lines(spark, path, glob, files, n_files, quote), files, n_files)[1])


def _profile(files: DataFrame, per_file: DataFrame) -> DataFrame:
    known = files.drop("encoding").join(per_file, "file", "left")
    encoding = F.when(F.coalesce("valid", F.lit(True)), F.lit("utf-8")).otherwise(F.lit("latin-1"))
    return known.select("file", "size_bytes", F.coalesce("records", F.lit(0)).cast("long").alias("records"), "columns", encoding.alias("encoding"), "delimiter", "enclosure", "quote", "header",
                        F.coalesce("inner", F.lit(0)).cast("long").alias("line_breaks"))


def scan_files(
    spark: SparkSession, path, glob: str | None = CSV_GLOB, delimiter: str | None = None, quote: str | None = '"', n_bytes: int = HEAD_BYTES,
) -> FileScan:
    """Every record of every CSV file under ``path``, numbered from 1 in the order of paths and lines.

    Each file's delimiter (unless given) and header are read from its head, its encoding is UTF-8 if
    all its bytes are, else Latin-1.  ``quote`` is one character, empty for none, or None for each
    file's detected enclosure.  Files are grouped by header and dialect; ``rows`` has the columns of all
    headers by name (in any case of its letters, as first written), and a column that a file lacks is
    ``''`` there, as is a missing cell.  Where a header has a column ``row_number`` or ``file``, the scan's own gets
    ``_`` before its name.  All cells are strings, blank lines are no records, and a line break between quotes is
    part of its cell.  A record with more cells than its header has the first ones in ``rows`` and is
    listed in ``refused``.  Lines end with ``\\n`` or ``\\r\\n``; files without a byte are not listed.
    """
    files = file_heads(spark, path, glob, n_bytes, quote)
    files = written(files if delimiter is None else files.withColumn("delimiter", F.lit(delimiter)), "heads")
    n_files = files.count()
    lines = _lines(spark, path, glob, files, n_files, quote)
    splits, per_file = _splits(lines, files, n_files)
    profile = written(_profile(files, per_file), "profile")
    group = ["header", "delimiter", "quote", "encoding"]
    groups = profile.where(F.col("header") != "").groupBy(*group).agg(F.min("file").alias("first")).orderBy("first").limit(MAX_HEADERS + 1).collect()
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers under {path}")
    kinds = [(k, *[g[c] for c in group]) for k, g in enumerate(groups)]
    kind_table = spark.createDataFrame(kinds, "kind int, header string, delimiter string, quote string, encoding string")
    of_file = profile.join(F.broadcast(kind_table), group).select("file", "kind", "encoding", "columns").join(_running_offsets(per_file), "file")
    numbered = splits.join(of_file, "file").withColumn("base", F.col("offset") + F.col("earlier")).withColumn("split", F.monotonically_increasing_id())
    numbered = written(numbered.withColumn("edge", F.col("opened") | F.col("odd")), "numbered")
    n_splits, n_edges = numbered.agg(F.count("*"), F.count_if("edge")).first()

    def cut(of: DataFrame, how: str) -> DataFrame:
        joined = lines.join(_small(of.select("file", "block", "split", "opened", "base"), n_splits), ["file", "block"], how)
        # a split that the first pass did not see would be lost in silence
        split = F.coalesce("split", F.raise_error(F.concat(F.lit("splits changed between passes: "), F.col("file"))).cast("long"))
        joined = joined.select(split.alias("split"), "opened", "base", "odd", "blank", F.col("value").cast("binary").alias("value"), "place")
        joined = joined if _fits(n_splits) else joined.sortWithinPartitions("split", "place")
        return joined.drop("place").mapInArrow(_cut_records, "split long, number long, part int, record binary")

    records = cut(numbered, "left").where("part = 0").select("split", "number", "record")
    if n_edges:
        records = records.unionByName(_glued(written(cut(numbered.where("edge"), "inner").where("part > 0"), "pieces"), numbered))
    records = records.join(_small(numbered.select("split", "file", "kind", "columns", "offset", "encoding"), n_splits), "split")
    text = F.when(F.col("encoding") == "utf-8", F.decode("record", "UTF-8")).otherwise(F.decode("record", "ISO-8859-1"))
    records = records.where(F.col("number") > F.col("offset")).withColumn("text", F.regexp_replace(text, r"\r\z", ""))
    return _parsed(records, kinds, profile)


def _glued(pieces: DataFrame, numbered: DataFrame) -> DataFrame:
    """``split, number, record`` of the records that cross split borders."""
    # pieces: two a split at most; each run of them begins with part 1
    order = Window.partitionBy("file").orderBy("block", F.col("part").desc())
    runs = pieces.join(numbered.select("split", "file", "block"), "split").withColumn("run", F.sum((F.col("part") == 1).cast("int")).over(order))
    glued = runs.groupBy("file", "run").agg(F.sort_array(F.collect_list(F.struct("block", (-F.col("part")).alias("turn"), "split", "number", "record"))).alias("x"))
    rest = F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0)))
    return glued.select(F.col("x")[0]["split"].alias("split"), F.col("x")[0]["number"].alias("number"),
                         F.aggregate(rest, F.col("x")[0]["record"], lambda a, p: F.concat(a, F.lit(b"\n"), p["record"])).alias("record"))


def _parsed(records: DataFrame, kinds: list[tuple], profile: DataFrame) -> FileScan:
    """One projection that parses each record by its file's dialect and places its cells by name."""
    names = [column_names(header, d, q) for _, header, d, q, _ in kinds]
    width = max([1, *map(len, names)])
    cells = ", ".join(f"c{i} string" for i in range(width))

    def parsed(d: str, q: str) -> Column:
        options = {"sep": d, "quote": q or "\u0000", "escape": '"' if q != "'" else "'", "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        return F.from_csv("text", cells, options)

    dialects = sorted({(d, q) for _, _, d, q, _ in kinds})
    parse, count = F.lit(None).cast(f"struct<{cells.replace(' string', ':string')}>"), F.lit(None).cast("int")
    for d, q in dialects:
        own = F.col("kind").isin([k for k, _, kd, kq, _ in kinds if (kd, kq) == (d, q)])
        parse = F.when(own, parsed(d, q)).otherwise(parse)
        count = F.when(own, count_cells(F.col("text"), F.lit(d), F.lit(q))).otherwise(count)
    spelled: dict[str, str] = {}
    for group in names:
        for name in group:
            spelled.setdefault(name.lower(), name)
    places = {low: {k: [x.lower() for x in group].index(low) for k, group in enumerate(names) if low in {x.lower() for x in group}} for low in spelled}
    table = records.select(F.col("number").alias("__n"), F.col("file").alias("__file"), "kind", parse.alias("p"))

    def cell(low: str) -> Column:
        by_place: dict[int, list[int]] = {}
        for k, place in places[low].items():
            by_place.setdefault(place, []).append(k)
        if len(by_place) == 1 and len(places[low]) == len(kinds):
            return F.coalesce(F.col(f"p.c{next(iter(by_place))}"), F.lit(""))
        value = F.lit(None).cast("string")
        for place, ks in by_place.items():
            value = F.when(F.col("kind").isin(ks), F.col(f"p.c{place}")).otherwise(value)
        return F.coalesce(value, F.lit(""))

    own = []
    for name, column in (("row_number", "__n"), ("file", "__file")):
        while name in spelled:
            name = f"_{name}"
        own.append(F.col(column).alias(name))
    rows = table.select(*own, *[cell(low).alias(name) for low, name in spelled.items()])
    refused = records.withColumn("cells", count).where(F.col("cells") > F.col("columns")).select("file", F.col("number").alias("row_number"), "cells", "columns", F.col("text").alias("record"))
    return FileScan(rows, refused, profile)
