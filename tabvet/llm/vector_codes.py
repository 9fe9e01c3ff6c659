"""Vector code compression: product codes with Orchard's search for the nearest entry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are below this in magnitude: squared distances fit 64 bits.
LIMIT = 2**27


def _odd(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def valid(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    v = vector.cast("array<double>")
    return F.coalesce(~F.exists(v, _odd), F.lit(False))


def neighbour_lists(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, entries, entries - 1): the other entries in the order of their squared
    distance (ties by index), and those distances."""
    gaps = ((books[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    own = np.arange(books.shape[1])
    gaps[:, own, own] = -1
    order = np.argsort(gaps, axis=2, kind="stable")[:, :, 1:]
    return order, np.take_along_axis(gaps, order, axis=2)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part and its squared distance; ties go to the lower index.

    Orchard's search: walk the list of the current entry, nearest neighbours first.  An
    entry that is nearer to the part (or as near, with a lower index) becomes the current
    one and the walk goes on with its list; entries that were looked at are marked.
    Entries beyond twice the current distance from the current entry cannot be nearer, nor
    as near, so there the walk ends.  All parts of a batch walk at once; distances are
    whole numbers, so the result is exact.
    """
    n, n_parts, width = parts.shape
    entries = books.shape[1]
    order, gaps = neighbour_lists(books)
    q, p = parts.reshape(n * n_parts, width), np.tile(np.arange(n_parts), n)
    best, at = np.zeros(len(q), np.intp), np.zeros(len(q), np.intp)
    d = ((q - books[p, 0]) ** 2).sum(axis=1)
    seen = np.zeros((len(q), entries), bool)
    seen[:, 0] = True
    live = np.arange(len(q))
    while True:
        live = live[at[live] < entries - 1]
        live = live[gaps[p[live], best[live], at[live]] <= 4 * d[live]]
        if not len(live):
            return best.reshape(n, n_parts), d.reshape(n, n_parts)
        e = order[p[live], best[live], at[live]]
        at[live] += 1
        new = ~seen[live, e]
        row, e = live[new], e[new]
        seen[row, e] = True
        de = ((q[row] - books[p[row], e]) ** 2).sum(axis=1)
        closer = (de < d[row]) | ((de == d[row]) & (e < best[row]))
        row = row[closer]
        best[row], d[row], at[row] = e[closer], de[closer], 0


def _matrix(column, n_parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n_parts, -1)


def _sums(books: np.ndarray):
    """Per batch: how many parts each entry has and their componentwise sums."""

    def run(batches):
        import pyarrow as pa

        n_parts, entries, width = books.shape
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(0), n_parts)
            at = (nearest(x, books)[0] + np.arange(n_parts) * entries).ravel()
            sums = np.zeros((n_parts * entries, width), np.int64)
            np.add.at(sums, at, x.reshape(-1, width))
            count = np.bincount(at, minlength=n_parts * entries)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(used) + 1, width), pa.int32()), pa.array(sums[used].ravel()))],
                names=["entry", "n", "sums"],
            )

    return run


def _codes(books: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            best, d = nearest(_matrix(b.column(2), len(books)), books) if len(b) else (np.zeros((0, 1), int), np.zeros((0, 1), int))
            code = ["".join(f"{e:02x}" for e in row) for row in best.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(d.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every kept vector, and the codebooks (parts, entries, width).

    A component x is floor(scale * x).  Vectors are cut into ``parts`` equal runs.  The codebook
    of each begins with that run of the vectors with the smallest ids (a null id is the last;
    vectors of one id in the order of their components; fewer vectors than ``entries`` give fewer
    entries), goes through ``rounds`` of assigning and replacing each used entry by the mean of its
    parts, rounded down, and codes are assigned once more.  ``code`` has two hex digits a part.

    Dropped are vectors that are null or hold a null, infinite or undefined component, and those
    that have another length than the one with the smallest id, or one that ``parts`` doesn't divide.
    Repeated rows count and come out as often as they are there; an empty table gives an empty result
    and no codebooks; a component of LIMIT / scale or more is an error, as distances would overflow.
    Other columns are not read.

    Only the codebooks and sums of fixed size a round pass through the driver.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    ).where(valid(F.col("v")))
    too_large = F.raise_error(F.lit("component out of range")).cast("long")
    in_range = lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).when(~_odd(x), too_large)
    rows = rows.select("vec_id", "label", F.transform("v", in_range).alias("x")).where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False)), np.zeros((parts, 0, 0), np.int64)
    length = len(first[0]["x"])
    rows = stored(rows.where(F.size("x") == length), "scaled")
    initial = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    width = length // parts
    books = np.array([r["x"] for r in initial], np.int64).reshape(-1, parts, width).swapaxes(0, 1)
    for _ in range(rounds):
        found = rows.select("x").mapInArrow(_sums(books), "entry int, n long, sums array<long>")
        totals = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)])
        books = books.copy()
        for r in totals.collect():  # parts * entries rows at most
            books[r["entry"] // books.shape[1], r["entry"] % books.shape[1]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    types = dict(rows.dtypes)
    return rows.mapInArrow(_codes(books), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over equal labels (null is one)."""
    codes = stored(codes, "codes")
    key = F.to_json(F.struct("label")).alias("_label")  # never null
    keyed = codes.select("*", key)
    groups = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_size"))
    return salted_join(keyed, groups, ["_label"], "_size", codes.count()).drop("_label", "_size")
