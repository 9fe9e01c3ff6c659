"""Inner searches of the operators that SQL cannot express, against plain versions."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabvet.llm import language, quality, toxicity
from tabvet.llm import queries as Q
from tabvet.llm.packing import best_two_fit
from tabvet.llm.tokens import vocabulary

from ..conftest import SF_SMALL


def _maximal(s):
    """Disjoint maximal segments by their definition: the best of the row, then those left and right of it."""

    def best(a, b):
        sums = [(sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(sums, default=None)
        if top is None or top[0] <= 0:
            return []
        return [*best(a, top[2]), (top[2], top[3] - 1, top[0]), *best(top[3], b)]

    return best(0, len(s))


def test_segments_against_all_spans():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        # odd numbers of sixty-fourths, all apart: no two spans tie, and sums are exact
        s = [float(x) / 64 for x in rng.choice([k for k in range(-255, 256, 2)], n, replace=False)]
        marked = rng.random(n) < 0.5
        row = [x if m else -0.5 for x, m in zip(s, marked)]
        places = [k for k in range(n) if marked[k]]
        got = toxicity.segments(places, [row[k] for k in places], drift=-0.5)
        # of spans of one sum the definition may take either; their sums, in order, are the same
        assert [z for *_, z in got] == [z for *_, z in _maximal(row)], row
        for first, last, total in got:
            assert total == sum(row[first : last + 1]) > 0
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("switch", [0.5, 2.0, 8.0])
def test_viterbi_against_all_paths(switch):
    rng = np.random.default_rng(12)
    for _ in range(60):
        steps, states = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = -rng.integers(0, 5, (steps, 1, states)).astype(np.float32)

        def value(path):
            return sum(float(scores[t, 0, k]) for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

        best = max(map(value, itertools.product(range(states), repeat=steps)))
        assert value(language.viterbi(scores, switch)[:, 0].tolist()) == pytest.approx(best)


def test_viterbi_of_texts_of_unlike_length():
    rng = np.random.default_rng(13)
    rows = [-rng.random((n, 3)).astype(np.float32) * 4 for n in (9, 5, 1)]
    grid = np.zeros((9, 3, 3), np.float32)
    for j, r in enumerate(rows):
        grid[: len(r), j] = r
    together = language.viterbi(grid, 1.0)
    for j, r in enumerate(rows):
        assert together[: len(r), j].tolist() == language.viterbi(r[:, None], 1.0)[:, 0].tolist()


def test_convolution_against_loops():
    rng = np.random.default_rng(14)
    W, K = quality.WIDTH, quality.FILTERS
    net = quality.Network(rng.normal(0, 1, (W, 512, K)).astype(np.float32), rng.normal(0, 1, K).astype(np.float32), rng.normal(0, 1, K).astype(np.float32), 0.25)
    texts = [b"", b"abc", rng.integers(32, 127, 300).astype(np.uint8).tobytes(), b"spam and eggs " * 60, rng.integers(0, 256, 1300).astype(np.uint8).tobytes()]
    for text, got in zip(texts, quality.probabilities(texts, net)):
        t = text.ljust(W, b"\0")
        x = [b | 256 * any(k >= lag and t[k : k + quality.RUN] == t[k - lag : k - lag + quality.RUN] and len(t) - k >= quality.RUN for lag in range(2, quality.LAGS + 1)) for k, b in enumerate(t)]
        logits = []
        for a in range(0, max(1, len(x) - quality.CHUNK + quality.STEP), quality.STEP):
            part = x[a : a + quality.CHUNK]
            tops = [max(sum(float(net.filters[j, part[p + j], f]) for j in range(W)) for p in range(len(part) - W + 1)) if len(part) >= W else None for f in range(K)]
            if None not in tops:
                logits.append(sum(max(0.0, m + float(net.bias[f])) * float(net.out[f]) for f, m in enumerate(tops)) + net.out_bias)
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(np.mean(logits), -30, 30))), abs=1e-5)


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    """Every chunk of a sampled text is learned from; a text too long for the sample is left out whole."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, w: seen.append((len(x), y.tolist(), w.tolist())) or fit(x, y, w))
    long = "some words of a long text " * 1000
    rows = [(1, long), (2, "short one"), (3, long + long), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, label int")
    n = {k: len(quality.chunk_starts(len(t or ""))) for k, t in rows}
    quality.train(docs, labels)
    assert seen[-1][0] == sum(n.values()) and n[1] > 60
    assert sum(seen[-1][2]) == pytest.approx(len(rows))
    quality.train(docs, labels, max_chunks=n[1] + 1)
    assert seen[-1][0] == sum(n.values()) - n[3]


def _fewest(lengths, size):
    """Bins that ``lengths`` need, by trying every place of every piece."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_packing_against_the_fewest_bins():
    rng = np.random.default_rng(15)
    over = 0
    for _ in range(80):
        lengths = sorted(rng.integers(1, 21, int(rng.integers(1, 10))).tolist(), reverse=True)
        bins = best_two_fit(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 20 for b in bins)
        more = len(bins) - _fewest(lengths, 20)
        assert 0 <= more <= 1
        over += more
    assert over <= 8


def test_smallest_piece_makes_room_for_two():
    # greedy leaves 9 with 5 (gap 6) beside 5 and 6 that fit the gap of 11 in its place exactly
    bins = best_two_fit([14, 4, 3, 3], 20)
    assert sorted(sorted([14, 4, 3, 3][i] for i in b) for b in bins) == [[3, 3, 14], [4]]


def test_pieces_of_the_query_against_the_library(spark):
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    corpus = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_SMALL}/documents.parquet'").fetchall()
    want = set()
    for doc, text in corpus:
        ids = np.asarray(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want |= {(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = Q.op6_best_fit_packing(spark, SF_SMALL).select("doc_id", "piece", "start", F.col("length"), "ids_crc32").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_words_with_marks_take_no_part_each_and_match_the_library(monkeypatch):
    """Distinct parts of a batch are looked up by word and marks; odd texts beside them change nothing."""
    from tokenizers import Tokenizer

    from tabvet.llm import tokens as T

    calls, part = [], T.Encoder.part
    monkeypatch.setattr(T.Encoder, "part", lambda self, p, lead: calls.append(p) or part(self, p, lead))
    words, marks = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(60)], ["", ".", ",", "!!", "%%%", ".,", "??"]
    texts = [" ".join(w + m for w in words[k:] for m in marks) + ("\n" + words[k] + ".\nEnd" if k % 3 else "") for k in range(40)]
    enc, library = T.Encoder(T.vocabulary(), 2, special=True), Tokenizer.from_file(T.vocabulary())

    def whole(t):
        return np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()

    assert enc.encode(texts) == [whole(t) for t in texts]
    assert len(calls) <= 2 * len(texts)  # a first word each; before, each of the 420 parts too
    odd = ["", " ", "a  b c.", " lead", "trail ", "x\n\ny z", "\nq r", "q r\n", "tab\tin it", "42 4x2, ñ. y", "...", "a ... b", "a\r\nb c", "日本語 テスト。 x", "𝔘𝔫 ít", *T.Encoder(T.vocabulary(), 2).added, "mid <|endoftext|> end"]
    assert enc.encode(odd + texts[:2] + odd) == [whole(t) for t in odd + texts[:2] + odd]
    monkeypatch.setattr(T, "ARROW_CHARS", 10)
    assert enc.encode(odd + texts[:2]) == [whole(t) for t in odd + texts[:2]]
    assert enc.encode([]) == []


def test_words_are_looked_up_once_whatever_marks_follow(monkeypatch):
    """Each part of a batch cost a lookup of its word and a scalar of its own."""
    from tokenizers import Tokenizer

    from tabvet.llm import tokens as T

    asked, get = [], dict.__getitem__
    enc, library = T.Encoder(T.vocabulary(), 2, special=True), Tokenizer.from_file(T.vocabulary())
    monkeypatch.setattr(T.Words, "__getitem__", lambda self, w: asked.append((self.lead, w)) or get(self, w), raising=False)
    tails = ["", ".", ",", "!", "...", "?!", ":;", "|", "$.", "#"]
    text = " ".join(["a", *[w + m for w in ("ernd", "señal", "überein", "日本語") for m in tails], "x1.", "q.\nz,", "..."])
    got = enc.encode([text, text])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*library.encode(text, add_special_tokens=False).ids, 2]] * 2
    assert [asked.count((" ", w)) for w in ("ernd", "señal", "überein", "日本語")] == [1] * 4
