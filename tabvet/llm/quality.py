"""Quality of texts by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled rows of each class that the network may learn from, by smallest hash of the id, and
#: the chunks that they give in all: a row whose whole text would pass this is not in the sample.
MAX_LABELLED, MAX_CHUNKS = 1_500, 12_000
CHUNK, STEP = 512, 384
WIDTH, FILTERS, EPOCHS, BATCH = 8, 16, 6, 128
#: A byte is marked when its next RUN bytes stood 2 to LAGS bytes before.
RUN, LAGS = 16, 24


@dataclass(frozen=True)
class Network:
    filters: np.ndarray  # (WIDTH, 512, FILTERS): by byte, and by byte in a repeated run
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes, plus 256 where a run is repeated at a short distance."""
    x = data.astype(np.int64)
    for lag in range(2, LAGS + 1):
        if len(data) < lag + RUN:
            break
        same = np.concatenate([[0], np.cumsum(data[lag:] == data[:-lag], dtype=np.int64)])
        x[lag : lag + len(same) - RUN][same[RUN:] - same[:-RUN] == RUN] |= 256
    return x


def chunk_starts(n: int) -> list[int]:
    """Starts of the overlapping chunks that cover ``n`` bytes."""
    return list(range(0, max(1, n - CHUNK + STEP), STEP))


def convolve(x: np.ndarray, net: Network) -> np.ndarray:
    """(positions, FILTERS) of symbols ``x``; at least WIDTH long."""
    n = len(x) - WIDTH + 1
    out = np.take(net.filters[0], x[:n], axis=0)
    for j in range(1, WIDTH):
        out += np.take(net.filters[j], x[j : j + n], axis=0)
    return out


def probabilities(texts: list[bytes], net: Network) -> np.ndarray:
    """Of label 1: the mean of the chunks' logits through a sigmoid."""
    out = np.empty(len(texts))
    for k, t in enumerate(texts):
        x = symbols(np.frombuffer(t + b"\0" * max(0, WIDTH - len(t)), np.uint8))
        starts, total = np.array(chunk_starts(len(x))), 0.0
        for a in range(0, len(starts), 64):  # a bounded stretch of a long text at a time
            some = starts[a : a + 64]
            part = convolve(x[some[0] : some[-1] + CHUNK], net)
            at = np.empty(2 * len(some), np.int64)
            at[0::2] = some - some[0]
            at[1::2] = np.minimum(at[0::2] + CHUNK - WIDTH + 1, len(part))
            ends = at[1::2]
            padded = np.concatenate([part, part[-1:]]) if ends[-1] >= len(part) else part
            top = np.maximum.reduceat(padded, at, axis=0)[0::2]
            total += float((np.maximum(top + net.bias, 0) @ net.out + net.out_bias).sum())
        out[k] = 1 / (1 + np.exp(-np.clip(total / len(starts), -30, 30)))
    return out


def fit(chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Adam on (chunks, CHUNK) symbols, 0/1 labels and weights; classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    scale = (weight * np.array([len(y) / 2 / max(1e-9, weight[y == k].sum()) for k in (0, 1)])[y.astype(int)]).astype(np.float32)
    n, t = CHUNK - WIDTH + 1, 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            x, t = chunks[some].astype(np.int64), t + 1
            h = np.take(p[0][0], x[:, :n], axis=0)
            for j in range(1, WIDTH):
                h += np.take(p[0][j], x[:, j : j + n], axis=0)
            top = h.argmax(axis=1)  # (chunks, FILTERS)
            z = np.take_along_axis(h, top[:, None], axis=1)[:, 0] + p[1]
            a = np.maximum(z, 0)
            q = 1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30)))
            d = ((q - y[some]) * scale[some] / len(some)).astype(np.float32)
            dz = np.where(z > 0, d[:, None] * p[2], 0).astype(np.float32)
            grads = [np.zeros_like(p[0]), dz.sum(axis=0), a.T @ d, np.array([d.sum()], np.float32)]
            rows, filters = np.arange(len(some))[:, None], np.arange(FILTERS)[None]
            for j in range(WIDTH):
                np.add.at(grads[0][j], (x[rows, top + j], np.broadcast_to(filters, top.shape)), dz)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Network(p[0], p[1], p[2], float(p[3][0]))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chunks: int = MAX_CHUNKS, text_col: str = "text") -> Network:
    """``labels``: ``doc_id`` and ``label`` (0 or 1, others are left out) of rows to learn from.

    At most ``max_labelled`` rows of each class, by smallest hash of the id, give all chunks of
    their whole texts, up to ``max_chunks`` a class: a row that would pass that is left out and
    the next one taken.  This bounded sample is fitted on the driver; a text weighs the same
    whatever its length.  Without both classes the network is that of no data: every text scores 0.5.
    """
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = None
    for k in (0, 1):
        some = named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = some if sample is None else sample.unionByName(some)
    ids = sample.select("doc_id", F.col("label").cast("int").alias("label")).toPandas()
    few = spark.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for doc, y, t in zip(*(c.to_pylist() for c in b.columns)):
                starts, x = chunk_starts(len(t)), symbols(np.frombuffer(t, np.uint8)).astype("<u2")
                for some in (starts[a : a + 1024] for a in range(0, len(starts), 1024)):
                    parts = [x[s : s + CHUNK].tobytes().ljust(2 * CHUNK, b"\0") for s in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([y] * len(some), pa.int32()), pa.array(parts, pa.binary())],
                        names=["doc_id", "at", "label", "chunk"],
                    )

    chunks = stored(rows.mapInArrow(cut, "doc_id long, at long, label int, chunk binary"), "chunks")
    sizes = chunks.groupBy("label", "doc_id").agg(F.count("*").alias("n")).orderBy("label", F.xxhash64("doc_id"), "doc_id").toPandas()  # a row a sampled id
    taken, room = [], {0: max_chunks, 1: max_chunks}
    for y, doc, n in zip(sizes["label"].tolist(), sizes["doc_id"].tolist(), sizes["n"].tolist()):
        if n <= room[y]:
            room[y] -= n
            taken.append((doc, n))
    if len(set(room.values()) & {max_chunks}):
        return Network(np.zeros((WIDTH, 512, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)
    mine = chunks.join(F.broadcast(spark.createDataFrame(taken, "doc_id long, n long")), "doc_id").toPandas().sort_values(["doc_id", "at", "chunk"])
    x = np.frombuffer(b"".join(mine["chunk"]), "<u2").reshape(len(mine), CHUNK)
    return fit(x, mine["label"].to_numpy(np.float32), 1 / mine["n"].to_numpy(float))


def score(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every whole text.

    One row for each row, repeated rows too; null text counts as empty, and an empty
    text is scored as bytes of 0; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            p = probabilities(b.column(b.num_columns - 1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(p)], names=[*keep, "score"])

    cols = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*cols, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"))
    return rows.mapInArrow(predict, f"{docs.select(*cols).schema.simpleString()[7:-1]}, score: double")
