"""Best-two-fit packing of token sequences into bins of one size."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoded, vocabulary

#: Pieces packed together; a group leaves at most about one loose bin.
GROUP_PIECES = 20_000


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths`` (each 1 to ``size``).

    A bin takes the longest piece that fits until none does.  Then its smallest
    piece is put back for the two unpacked pieces that fill the room left by it
    best, if they fill more than it did.
    """
    have: list[list[int]] = [[] for _ in range(size + 1)]
    for k, n in enumerate(lengths):
        have[n].append(k)
    mask = sum(1 << n for n in range(1, size + 1) if have[n])  # lengths that are left
    below = [(1 << (n + 1)) - 1 for n in range(size + 1)]
    bins = []

    def take(n: int) -> int:
        nonlocal mask
        k = have[n].pop()
        if not have[n]:
            mask &= ~(1 << n)
        return k

    while mask:
        gap, members = size, []
        while gap and (n := (mask & below[gap]).bit_length() - 1) > 0:
            members.append(take(n))
            gap -= n
        while gap and mask:
            small = min(range(len(members)), key=lambda i: lengths[members[i]])
            s = lengths[members[small]]
            room, best, pair = gap + s, s, None
            a = (mask & below[room - 1]).bit_length() - 1
            while a > 0 and 2 * a > best:
                most = min(a, room - a)
                if most == a and len(have[a]) < 2:
                    most -= 1
                b = (mask & below[most]).bit_length() - 1 if most > 0 else 0
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = (mask & below[a - 1]).bit_length() - 1
            if not pair:
                break
            out = members[small]
            members[small] = take(pair[0])
            members.append(take(pair[1]))
            have[s].append(out)
            mask |= 1 << s
            gap = room - best
        bins.append(members)
    return bins


def cut(docs: DataFrame, size: int = 1024, vocabulary_path: str | None = None, end_id: int | None = 2,
        id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every whole text.

    A document of up to ``size`` ids is one piece; of a longer one the first piece
    takes what is over, and the rest are full.  Null text counts as empty.
    """
    voc = vocabulary_path or vocabulary()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for doc, x in encoded(batch.column(0).to_pylist(), batch.column(1).to_pylist(), voc, end_id):
                n = len(x) // 4
                at, k = 0, 0
                length = (n - 1) % size + 1 if n else 0
                while at < n:
                    ids = x[4 * at : 4 * (at + length)]
                    rows.append((doc, k, at, length, zlib.crc32(ids), ids)[: 5 + keep_ids])
                    at, k, length = at + length, k + 1, size
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names[: len(cols)])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, schema)


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``size`` ids.

    Pieces are dealt by hash, of their place in the written table too so that equal
    rows spread, into groups of about GROUP_PIECES, each packed in one
    task by best-two-fit, so no task grows with the input.  Rows stay row for row,
    repeated ones too; null ids are kept; an empty table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    n = pieces.count()
    groups = n // GROUP_PIECES + 1
    schema = pieces.schema.simpleString()[7:-1] + ", sequence_id bigint, offset bigint"

    def place(pdf):
        bins = best_two_fit(pdf["length"].tolist(), size)
        group, lengths = int(pdf["_group"].iloc[0]), pdf["length"].tolist()
        seq, off = [0] * len(pdf), [0] * len(pdf)
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = (group << 32) + k, at
                at += lengths[i]
        return pdf.drop(columns="_group").assign(sequence_id=seq, offset=off)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(place, schema)
