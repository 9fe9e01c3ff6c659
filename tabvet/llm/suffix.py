"""Repeated byte strings across documents, by a sampled suffix array in range-partitioned buckets.

A byte goes when a string of LENGTH bytes that covers it starts earlier too.  The
strings are the windows of the suffix array; a row for each of them would be
dozens of times the input, so suffixes are sampled by content: of the leading
LEAD-byte grams inside a window the one with the least hash is its anchor
(leftmost of equals).  Equal windows have equal anchors at the same place, so each
window belongs to one sampled suffix, and nothing is lost.  A sampled suffix
stands for the run of windows that it anchors; its context is the text they cover.

1. Anchored suffixes are range-partitioned by their leading bytes, then id and
   position: Spark samples the splitters, and a hot string is split over as many
   buckets as it needs.  Each bucket sorts locally by multikey quicksort.  A suffix
   whose whole context stands earlier in its run of equal leads is repeated as a
   whole.  The first and last run of a bucket may go on in its neighbours; there
   each distinct context sends its first row to a comparison across boundaries.
2. Runs that hold different contexts are the ends of repeats.  One suffix of each
   context gets its text, and buckets of the same kind compare window by window.
3. Repeated windows meet their documents.

Contexts are compared by 64-bit hashes among suffixes that share LEAD bytes, windows
by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_row_per_text, partitions, stored, with_ids
from .words import _powers, mix

LENGTH, LEAD = 100, 16
BATCH_BYTES = 250_000
#: Windows compared at a time; a run of equal leads may have many more.
WINDOWS = 250_000
_SMALL = 4096
_UP, _UP2 = 0x9DDFEA08EB382D69, 0xB492B66FBE98F273


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by ``keys``, one 8-byte word after another: three-way partition
    on a word; rows equal in it go on with the next word."""
    n = len(keys[0])
    out, stack = np.empty(n, np.int64), [(np.arange(n), 0, 0)]
    while stack:
        rows, depth, at = stack.pop()
        if depth == len(keys):
            out[at : at + len(rows)] = rows
        elif len(rows) <= _SMALL:
            out[at : at + len(rows)] = rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])]
        else:
            k = keys[depth][rows]
            pivot = np.sort(k[:: max(1, len(k) // 63)])[31]
            less, more = k < pivot, k > pivot
            parts = rows[less], rows[~(less | more)], rows[more]
            for part, d in zip(parts, (depth, depth + 1, depth)):
                if len(part):
                    stack.append((part, d, at))
                at += len(part)
    return out


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _powers(f"up{base}", base, len(data)), dtype=np.uint64)])


def _slices(prefix: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of slices, from their prefix sums."""
    return mix((prefix[end] - prefix[start]) * _powers(f"down{base}", pow(base, -1, 2**64), len(prefix))[start] + (end - start).astype(np.uint64))


def _eight(data: np.ndarray) -> np.ndarray:
    """The big-endian word of the 8 bytes at each place."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def anchored(texts: list[bytes]):
    """Of all windows of ``texts``: for each anchor its text, lead words, context hash and
    span: position << 16 | bytes back to the first window << 8 | back to the last."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty
    word = _eight(data)
    h = (word ^ (np.concatenate([word[8:], np.zeros(8, np.uint64)]) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    low = ((h >> bits) << bits) | np.arange(len(data), dtype=np.uint64)
    reach, width = LENGTH - LEAD + 1, 1
    while 2 * width <= reach:  # low[i] becomes the least of width keys from i on
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :]) if reach > width else low
    first = np.repeat(starts + lengths - LENGTH, lengths)  # the last window of the text at each place
    at = np.flatnonzero(np.arange(len(data)) <= first)
    anchor = (low[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else empty
    a, lo = anchor[edge], at[edge]
    hi = at[np.concatenate([edge[1:], [len(at)]]) - 1] if len(at) else empty
    prefix = _prefix(data, _UP)
    ctx = mix(_slices(prefix, _UP, lo, hi + LENGTH) + (a - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9)).view(np.int64)
    of = np.searchsorted(starts, a, side="right") - 1
    return of, _signed(word[a]), _signed(word[a + 8]), ctx, ((a - starts[of]) << 16) | ((a - lo) << 8) | (a - hi)


def _back(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of a span."""
    at = span >> 16
    return at - ((span >> 8) & 255), at - (span & 255)


def _concat(batches) -> list:
    import pyarrow as pa

    held = list(batches)
    return [] if not held else list(pa.Table.from_batches(held).combine_chunks().columns)


def _runs(lead0: np.ndarray, lead1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each sorted row's run, and whether the run may go on in another bucket."""
    run = np.concatenate([[0], np.cumsum((lead0[1:] != lead0[:-1]) | (lead1[1:] != lead1[:-1]))])
    return run, (run == 0) | (run == run[-1])


def _first(run: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Whether a row is the first of its run with its item."""
    order = np.lexsort([*items, run])  # stable: the earliest row of equals comes first
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in (run, *items)], axis=0)])
    out = np.zeros(len(run), bool)
    out[order[new]] = True
    return out


WHOLE, PART, EDGE = 0, 1, 2  # repeated as a whole; compare its windows; compare across boundaries


def _compare_contexts(batches):
    import pyarrow as pa

    cols = [c.to_numpy() for c in _concat(batches)]
    if not cols or not len(cols[0]):
        return
    order = multikey_quicksort([cols[i] for i in (0, 1, 3, 4)])
    lead0, lead1, ctx, ids, span = (c[order] for c in cols)
    run, edge = _runs(lead0, lead1)
    first = _first(run, [ctx])
    contexts = np.bincount(run, weights=first)[run]
    kind = np.where(~first, WHOLE, np.where(edge, EDGE, PART)).astype(np.int32)
    keep = ~first | edge | (contexts > 1)
    for k in range(0, len(kind), 100_000):
        some = np.flatnonzero(keep[k : k + 100_000]) + k
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (kind, lead0, lead1, ctx, ids, span)], names=["kind", "lead0", "lead1", "ctx", "_id", "span"])


def _windows(lead_rows, bodies: list[bytes], lo: np.ndarray, hi: np.ndarray):
    """Every window of the contexts: its row, its two hashes, its start."""
    n = hi - lo + 1
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + step
    hashes = [_slices(_prefix(data, b), b, at, at + LENGTH).view(np.int64) for b in (_UP, _UP2)]
    return lead_rows[row], hashes[0], hashes[1], lo[row] + step, row


def _bands(span: np.ndarray):
    """Rows with their first and last window, about WINDOWS windows at a time.  Equal windows have
    their anchor at the same place, so where runs are long each band of places is compared alone."""
    lo, hi = _back(span)
    at, far = span >> 16, int(((span >> 8) & 255).max())
    step = max(1, (far + 1) * WINDOWS // int((hi - lo + 1).sum()))
    for place in range(0, far + 1, step):
        a, z = np.maximum(lo, at - (place + step - 1)), np.minimum(hi, at - place)
        rows = np.flatnonzero(a <= z)
        if len(rows):
            yield rows, a[rows], z[rows]


def _compare_windows(batches):
    import pyarrow as pa

    cols = _concat(batches)
    if not cols or not len(cols[0]):
        return
    lead0, lead1, ids, span = (cols[i].to_numpy() for i in range(4))
    order = multikey_quicksort([lead0, lead1, ids, span])
    lead0, lead1, ids, span = lead0[order], lead1[order], ids[order], span[order]
    run, edge = _runs(lead0, lead1)
    cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    # whole runs at a time, about 0.3 MB of text; of a longer run some places at a time
    at = 0
    while at < len(run):
        end = int(np.searchsorted(cuts, at + 2_000, side="left"))
        end = int(cuts[end]) if end < len(cuts) else len(run)
        some = slice(at, end)
        bodies, starts = cols[4].take(pa.array(order[some])).to_pylist(), _back(span[some])[0]
        for rows, lo, hi in _bands(span[some]):
            texts = [bodies[i][x : y + LENGTH] for i, x, y in zip(rows.tolist(), (lo - starts[rows]).tolist(), (hi - starts[rows]).tolist())]
            of_run, w0, w1, start, row = _windows(run[some][rows], texts, lo, hi)
            first = _first(of_run, [w0, w1])
            on_edge, doc = edge[some][rows][row], ids[some][rows][row]
            kind = np.where(first, EDGE, WHOLE).astype(np.int32)
            keep = ~first | on_edge
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (kind, w0, w1, doc, start)], names=["kind", "w0", "w1", "_id", "start"])
        at = end


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, kept, removed`` of every whole text as UTF-8 bytes.

    Each byte goes that a string of LENGTH bytes covers which also starts earlier:
    in a smaller id, or earlier in the same text.  Strings are those of the input and
    never cross documents.  ``kept`` are the other bytes in a row, ``removed`` the
    start and length of each maximal run that went.

    Null text counts as empty, texts under LENGTH bytes stay whole; rows equal in
    id (null is an id and comes first) and text are one document, others that repeat an
    id are documents of their own; an empty table gives an empty result; other columns are not read.
    """
    n = partitions(docs.sparkSession)
    rows, outer = one_row_per_text(docs, id_col, text_col)
    rows = rows.select("_id", F.col("_text").cast("binary").alias("body"))

    def suffixes(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts, at = b.column(0).to_numpy(), b.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                of, lead0, lead1, ctx, span = anchored(texts[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (lead0, lead1, ctx, ids[at:end][of], span)], names=["lead0", "lead1", "ctx", "_id", "span"])
                at = end

    def contexts(batches):
        import pyarrow as pa

        for b in batches:
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                span = np.array(spans, np.int64)
                lo, hi = _back(span)
                word = [np.frombuffer(b"".join(text[a : a + 8] for a in ((span >> 16) + k).tolist()), ">u8").astype(np.uint64) for k in (0, 8)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(word[0])), pa.array(_signed(word[1])), pa.array(np.full(len(span), doc)), pa.array(span), pa.array([text[a : z + LENGTH] for a, z in zip(lo.tolist(), hi.tolist())], pa.binary())],
                    names=["lead0", "lead1", "_id", "span", "body"],
                )

    def cut(batches):
        import pyarrow as pa

        removed_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for b in batches:
            size, gone, kept, runs = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                size.append(len(text))
                if not spans:
                    gone.append(0)
                    kept.append(text)
                    runs.append([])
                    continue
                x = np.array(spans, np.int64)
                cover = np.zeros(len(text) + 1, np.int32)
                np.add.at(cover, x >> 8, 1)
                np.add.at(cover, (x >> 8) + (x & 255) + LENGTH, -1)
                out = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                gone.append(int(out.sum()))
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                runs.append([{"start": s, "length": e - s} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, removed_type)], names=["_id", "n_bytes", "n_removed", "kept", "removed"])

    sampled = rows.mapInArrow(suffixes, "lead0 long, lead1 long, ctx long, _id long, span long")
    dealt = sampled.repartitionByRange(n, "lead0", "lead1", "_id", "span")
    compared = stored(dealt.mapInArrow(_compare_contexts, "kind int, lead0 long, lead1 long, ctx long, _id long, span long"), "contexts")
    by_context = Window.partitionBy("lead0", "lead1", "ctx").orderBy("_id", "span")  # at most one row a bucket
    edges = compared.where(F.col("kind") == EDGE).withColumn("nth", F.row_number().over(by_context))
    whole = compared.where(F.col("kind") == WHOLE).select("_id", "span").unionByName(edges.where("nth > 1").select("_id", "span"))
    parts = compared.where(F.col("kind") == PART).select("_id", "span").unionByName(edges.where("nth = 1").select("_id", "span"))

    wanted = parts.groupBy("_id").agg(F.collect_list("span").alias("spans"))  # bounded by the document
    found = rows.join(wanted, "_id").mapInArrow(contexts, "lead0 long, lead1 long, _id long, span long, body binary")
    near = found.repartitionByRange(n, "lead0", "lead1", "_id", "span")
    windows = stored(near.mapInArrow(_compare_windows, "kind int, w0 long, w1 long, _id long, start long"), "windows")
    by_window = Window.partitionBy("w0", "w1").orderBy("_id", "start")  # at most one row a bucket
    ends = windows.where(F.col("kind") == EDGE).withColumn("nth", F.row_number().over(by_window)).where("nth > 1")

    at, back = F.shiftright("span", 16), F.shiftright("span", 8).bitwiseAND(F.lit(255))
    run = F.shiftleft(at - back, 8) + back - F.col("span").bitwiseAND(F.lit(255))  # first window << 8 | further windows
    single = F.shiftleft("start", 8).alias("run")
    flagged = whole.select("_id", run.alias("run")).unionByName(windows.where(F.col("kind") == WHOLE).select("_id", single)).unionByName(ends.select("_id", single))
    runs = flagged.groupBy("_id").agg(F.collect_list("run").alias("runs"))  # bounded by the document
    out = rows.join(runs, "_id", "left").mapInArrow(cut, "_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,length:long>>")
    return with_ids(out, outer).select("doc_id", "n_bytes", "n_removed", "kept", "removed")
