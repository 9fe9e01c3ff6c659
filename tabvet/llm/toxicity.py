"""Toxic passages: maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Labelled rows of each class that the model learns from, by smallest hash of the id.
MAX_LABELLED = 20_000
#: The Dirichlet prior is the corpus itself at this share of its tokens.  A token scores
#: its log-odds if they and their z are at least these.
PRIOR, LEAST_ODDS, LEAST_Z = 0.1, 2.0, 3.5
#: Beginnings of tokens that have log-odds too, for words with many endings; the longest known counts.
PREFIXES = (8, 7, 6, 5, 4)
#: What every other token costs; with it the expected score of clean text is below 0.
DRIFT = -0.02
#: Bytes of text that are taken at once.
BATCH_BYTES = 2_000_000
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    rate: float  # lambda of the extreme-value law
    scale: float  # its K
    line: tuple[float, float]  # of the probability's logit


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a token row.

    ``places`` are the tokens with scores of their own; the others cost ``drift``.
    One pass with a stack of candidates, each with the cumulative score before and
    after it; a candidate joins those back to the nearest that starts lower.
    """
    found: list[list[float]] = []  # first, last, before, after
    total, last = 0.0, -1
    for at, s in zip(places, scores):
        total += drift * (at - last - 1)
        last = at
        if s > 0:
            one = [at, at, total, total + s]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= one[2]:
                    j -= 1
                if j < 0 or found[j][3] >= one[3]:
                    break
                one = [found[j][0], one[1], found[j][2], one[3]]
                del found[j:]
            found.append(one)
        total += s
    return [(int(f), int(z), after - before) for f, z, before, after in found]


def _tokens(texts):
    """Arrow texts to codes of their tokens, distinct tokens and token counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(parts.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), pc.utf8_trim(coded.dictionary, characters=MARKS), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


def _forms(tokens):
    """Arrow tokens, then their beginnings (with ``*``; null where the token is shorter)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    yield tokens
    lengths = pc.utf8_length(tokens)
    for k in PREFIXES:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(tokens, 0, k), "*", "")
        yield pc.if_else(pc.greater_equal(lengths, k), start, pa.scalar(None, pa.string()))


def _found(texts, words, values: np.ndarray) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """Of each text: its tokens and segments."""
    import pyarrow.compute as pc

    codes, tokens, counts = _tokens(texts)
    of = np.zeros(len(tokens))
    for form in _forms(tokens) if len(values) else ():
        at = pc.index_in(form, words, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        of = np.where((of == 0) & (at >= 0), values[at], of)
    s = of[codes]
    own = np.flatnonzero(s)
    ends = np.cumsum(counts)
    cut = np.searchsorted(own, ends)
    out, start = [], 0
    for n, end, k in zip(counts.tolist(), ends.tolist(), cut.tolist()):
        mine = own[start:k]
        out.append((n, segments((mine - (end - n)).tolist(), s[mine].tolist()) if len(mine) else []))
        start = k
    return out


def statistic(n: int, found: list[tuple[int, int, float]], rate: float, scale: float) -> float:
    """Sum over segments of the nats by which they pass what clean text of this length gives."""
    room = math.log(max(scale * max(n, 1), 1.0))
    return sum(max(0.0, rate * s - room) for _, _, s in found)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text_col: str = "text") -> Model:
    """``labels``: ``doc_id`` and ``label`` (0 or 1, others are left out) of rows to learn from.

    At most ``max_labelled`` rows of each class are taken, so their ids are few
    enough to broadcast; copies among their texts, the same but for case and white
    space, count once.  Log-odds are of documents that hold a token.
    """
    spark = docs.sparkSession
    named = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = None
    for k in (0, 1):
        some = named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = some if sample is None else sample.unionByName(some)
    ids = sample.select("doc_id", F.col("label").cast("int").alias("label")).toPandas()
    sample = spark.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("label", "text")

    def count(batches):
        import pyarrow as pa

        for b in sliced(batches, BATCH_BYTES):
            codes, tokens, counts = _tokens(b.column(1))
            once = np.unique(np.repeat(np.arange(len(b)), counts) * max(1, len(tokens)) + codes)
            doc, codes = np.divmod(once, max(1, len(tokens)))
            toxic = (b.column(0).to_numpy(zero_copy_only=False) == 1)[doc]
            n = [np.bincount(codes[toxic == t], minlength=len(tokens)) for t in (False, True)]
            for form in _forms(tokens):
                yield pa.RecordBatch.from_arrays([form, pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], names=["token", "clean", "toxic"])

    # copies say nothing new: of texts that are the same but for case and white space one is counted
    same = F.sha2(F.btrim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    apart = rows.groupBy("label", same.alias("same")).agg(F.max("text").alias("text")).select("label", "text")
    counts = apart.mapInArrow(count, "token string, clean long, toxic long").where("token is not null and token <> ''").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("not endswith(token, '*')").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = float(total["clean"] or 0), float(total["toxic"] or 0)
    if not n0 or not n1:
        return Model({}, 1.0, 1.0, (-5.0, 0.0))
    prior, weight = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")), PRIOR * (n0 + n1)
    a0, a1 = F.col("clean") + prior, F.col("toxic") + prior
    odds = F.log(a1 / (n1 + weight - a1)) - F.log(a0 / (n0 + weight - a0))
    z = odds / F.sqrt(1 / a0 + 1 / a1)
    scored = counts.select("token", "clean", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).toPandas()
    whole = ~scored["token"].str.endswith("*")
    scores = dict(zip(scored["token"], scored["odds"].astype(float)))
    if not scores:
        return Model({}, 1.0, 1.0, (-5.0, 0.0))

    # lambda: the positive root of sum of p * exp(lambda * s) = 1 over clean tokens
    s, p = scored["odds"].to_numpy(float)[whole], (scored["clean"].to_numpy(float)[whole] + 0.5) / (n0 + 1.0)
    value = lambda x: float((p * np.exp(x * s)).sum() + max(0.0, 1 - p.sum()) * math.exp(x * DRIFT) - 1)
    low, high = 1e-3, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    rate = (low + high) / 2
    words, values = list(scores), np.array(list(scores.values()))

    def found(batches):
        import pyarrow as pa

        lexicon = pa.array(words)
        for b in sliced(batches, BATCH_BYTES):
            got = _found(b.column(1), lexicon, values)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([[x for *_, x in f] for _, f in got], pa.list_(pa.float64()))], names=["label", "n", "scores"]
            )

    learned = rows.mapInArrow(found, "label int, n long, scores array<double>").toPandas()  # of the bounded sample
    clean = learned[learned["label"] == 0]
    tops = np.array([max(x, default=0.0) for x in clean["scores"]])
    scale = len(clean) / max(1e-9, float((np.maximum(clean["n"].to_numpy(float), 1) * np.exp(-rate * tops)).sum()))
    x = np.array([math.log1p(statistic(n, [(0, 0, s) for s in f], rate, scale)) for n, f in zip(learned["n"], learned["scores"])])
    y, w = learned["label"].to_numpy(float), np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):  # Newton's steps of a ridge logistic line
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - q) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    return Model(scores, rate, scale, (float(w[0]), float(w[1])))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``score`` (0 to 1) and ``passages`` (first word, words, score).

    Passages are those beyond what clean text of the length gives.  One row for each
    row, repeated rows too; null text counts as empty and scores as text without a
    known token; a model that learned from no or one class scores all rows alike;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the scored tokens of the bounded sample

    def predict(batches):
        import pyarrow as pa

        m = shared.value
        words, values = pa.array(list(m.scores), pa.string()), np.array(list(m.scores.values()))
        passage = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())]))
        for b in sliced(batches, BATCH_BYTES):
            got = _found(b.column(b.num_columns - 1), words, values)
            logits = np.array([m.line[0] + m.line[1] * math.log1p(statistic(n, f, m.rate, m.scale)) for n, f in got])
            spans = [[{"first_word": i, "n_words": z - i + 1, "score": s} for i, z, s in f if m.rate * s > math.log(max(m.scale * max(n, 1), 1.0))] for n, f in got]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30)))), pa.array(spans, passage)], names=[*keep, "score", "passages"])

    cols = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*cols, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    types = docs.select(*cols).schema.simpleString()[7:-1]
    return rows.mapInArrow(predict, f"{types}, score: double, passages: array<struct<first_word:int,n_words:int,score:double>>")
