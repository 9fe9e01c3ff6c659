"""Token-id files in patched frame-of-reference blocks.

A segment is a run of whole documents.  Its ids are cut into blocks of 128; a
block keeps its minimum, a bit width, the differences to the minimum packed at
that width, and a list of exceptions.  The width is the one that the block's
90th-percentile difference needs; larger differences are exceptions, stored
whole.  A segment holds a document table and the start of each block, so a
reader can go to any document without decoding what stands before it.

Layout of a segment, little-endian:
``PFR1``, u32 documents, u64 ids, u32 blocks; i64 id and u32 length of each
document; u32 start of each block, from the end of this index; then each block:
u32 minimum, u8 width, u8 exceptions, 16 * width bytes packed, one u8 place an
exception, one u32 difference an exception.

Packing goes by bit planes of 32-bit words: 128 values of width w are 4 * w words.

Segments are rows of Parquet files that Spark's writer commits, so a lost
executor or a repeated task leaves no half file; each row has its place:
``part`` (range of ids), ``seg``, ``start`` in the part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import one_row_per_text, outer_id, partitions
from .tokens import encoded, vocabulary

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))) + 1).astype(np.int64)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 128) values below 2**w to (blocks, 16 * w) bytes."""
    if w == 0:
        return np.empty((len(v), 0), np.uint8)
    cols, words = np.ascontiguousarray(v.T.astype(np.uint64)), np.zeros((2 * w + 1, len(v)), np.uint64)
    for j in range(BLOCK):
        k, s = divmod(j * w, 64)
        words[k] |= cols[j] << np.uint64(s)
        if s + w > 64:
            words[k + 1] |= cols[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(words[: 2 * w].T).view(np.uint8).reshape(len(v), 16 * w)


def _unpack(b: np.ndarray, w: int) -> np.ndarray:
    """The reverse of ``_pack``."""
    out = np.zeros((BLOCK, len(b)), np.uint32)
    if w:
        words, mask = np.ascontiguousarray(np.ascontiguousarray(b).view("<u8").T), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            k, s = divmod(j * w, 64)
            x = words[k] >> np.uint64(s)
            if s + w > 64:
                x = x | (words[k + 1] << np.uint64(64 - s))
            out[j] = x & mask
    return np.ascontiguousarray(out.T)


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    nb = -(-n // BLOCK)
    v = np.empty(nb * BLOCK, np.uint32)
    v[:n] = ids
    v[n:] = ids[-1] if n else 0
    v = v.reshape(nb, BLOCK)
    low = v.min(axis=1, initial=2**32 - 1) if nb else np.empty(0, np.uint32)
    v = v - low[:, None]
    width = _widths(np.partition(v, int(PERCENTILE * BLOCK), axis=1)[:, int(PERCENTILE * BLOCK)]) if nb else np.empty(0, np.int64)
    odd = v >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_odd = odd.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(int(starts[-1]), np.uint8)
    starts = starts[:-1]
    if nb:
        out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(nb, 4)
        out[starts + 4], out[starts + 5] = width, n_odd
        inside = np.where(odd, 0, v)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            out[starts[at][:, None] + 6 + np.arange(16 * w)] = _pack(inside[at], int(w))
        row, place = np.nonzero(odd)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        lists = starts + 6 + 16 * width
        out[lists[row] + nth] = place
        out[(lists + n_odd)[row][:, None] + 4 * nth[:, None] + np.arange(4)] = v[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = np.array([(b"PFR1", len(doc_ids), n, nb)], _HEAD)
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), out.tobytes()])


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths, and the ids of all documents in a row."""
    head = np.frombuffer(payload, _HEAD, 1)[0]
    if head["magic"] != b"PFR1":
        raise ValueError("not a token segment")
    docs, n, nb, at = int(head["docs"]), int(head["ids"]), int(head["blocks"]), _HEAD.itemsize
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(payload, "<u4", nb, at + 12 * docs).astype(np.int64)
    data = np.frombuffer(payload, np.uint8, offset=at + 12 * docs + 4 * nb)
    if not nb:
        return doc_ids, lengths, np.empty(0, np.uint32)
    low = data[starts[:, None] + np.arange(4)].view("<u4").reshape(-1)
    width, n_odd = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    v = np.empty((nb, BLOCK), np.uint32)
    for w in np.unique(width):
        k = np.flatnonzero(width == w)
        v[k] = _unpack(data[starts[k][:, None] + 6 + np.arange(16 * w)], int(w))
    row = np.repeat(np.arange(nb), n_odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    lists = starts + 6 + 16 * width
    place = data[lists[row] + nth]
    v[row, place] = data[(lists + n_odd)[row][:, None] + 4 * nth[:, None] + np.arange(4)].view("<u4").reshape(-1)
    return doc_ids, lengths, (v + low[:, None]).reshape(-1)[:n]


SEGMENTS = "part int, seg int, start long, n_docs int, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int | None = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids to ``path`` in ascending id order.

    Null text counts as empty (``end_id`` alone); rows equal in id (null is
    an id and comes first) and text are one document, others that repeat an id follow
    each other; an empty table
    gives a folder without segments.  Other columns are not read.
    """
    spark, voc = docs.sparkSession, vocabulary_path or vocabulary()

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seg, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, bytes]] = []
        n = 0

        def row():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            payload = write_segment(np.array([d for d, _ in held], np.int64), np.array([len(x) // 4 for _, x in held], np.uint32), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([start], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "seg", "start", "n_docs", "n_ids", "payload"],
            )

        for b in batches:
            for doc, x in encoded(b.column(0).to_pylist(), b.column(1).to_pylist(), voc, end_id):
                held.append((doc, x))
                n += len(x) // 4
                if n >= SEGMENT_IDS:
                    yield row()
                    seg, start, n, held = seg + 1, start + n, 0, []
        if held:
            yield row()

    rows, outer = one_row_per_text(docs, id_col, text_col)
    ordered = (rows if outer is None else rows.join(outer, "_id")).repartitionByRange(partitions(spark), "_id").sortWithinPartitions("_id")
    if outer is not None:
        ordered = ordered.select("_outer", "_text")
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian u32 bytes) of each document in the files.

    ``start`` counts the ids of all documents before it.  The starts of the parts
    come from one total a part, as many rows as the writer had partitions.
    """
    segs = spark.read.schema(SEGMENTS).parquet(path)
    parts = segs.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("part", before.alias("base"))

    def documents(batches):
        import pyarrow as pa

        for b in batches:
            for first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids, lengths, ids = read_segment(payload)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                texts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(texts, pa.binary())],
                    names=["_id", "start", "n_tokens", "ids"],
                )

    placed = segs.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start")).alias("first"), "payload")
    out = placed.mapInArrow(documents, "_id long, start long, n_tokens long, ids binary")
    return out.select(outer_id().alias("doc_id"), "start", "n_tokens", "ids")


