"""Language of texts, and of their spans, by Viterbi over per-word scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the letter pairs and triples of one language.
BUCKETS = 1 << 14
#: Nats that a change of language costs; a word counts for at most CLIP more than another language.
SWITCH, CLIP = 8.0, 4.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: First code points of ranges of letters, and the script of each.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
CELLS = 2_000_000


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, langs): log-probability, less the mean over languages
    scripts: np.ndarray  # (scripts, langs): candidates


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(words: list[str]):
    """Of each word: gram buckets and the word of each gram, letters, script of the first letter (-1: none)."""
    cp = np.frombuffer((" " + " ".join(words) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths
    word = np.repeat(np.arange(len(words)), lengths + 1)  # of a word's letters and the space before it
    letter = _is_letter()[cp] | (cp == 32)
    c = cp.astype(np.uint64)
    n = len(word)
    two, three = c[:n] * np.uint64(0x9E3779B1) + c[1 : n + 1] * np.uint64(0x85EBCA77), c[2 : n + 2] * np.uint64(0xC2B2AE3D)
    two_ok = letter[:n] & letter[1 : n + 1]
    three_ok = two_ok & letter[2 : n + 2] & (cp[1 : n + 1] != 32)  # a gram ends with its word
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
    grams = np.concatenate([mix(two)[two_ok], mix(two + three)[three_ok]])
    of = np.concatenate([word[two_ok], word[three_ok]])
    alpha = _is_letter()[cp[:n]]
    n_letters = np.bincount(word[alpha], minlength=len(words))
    first = np.full(len(words), -1, np.int64)
    at = np.flatnonzero(alpha)[::-1]
    script = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
    first[word[at]] = script[np.searchsorted([x for x, _ in SCRIPTS], cp[at], side="right") - 1]
    return grams, of, n_letters, first


def _words(texts):
    """Arrow texts to codes of their words, distinct words, and word counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(parts.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), counts.astype(np.int64)


def _batches(batches, limit: int = 4_000_000):
    """Record batches cut to about ``limit`` bytes of their second column."""
    for b in batches:
        sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32, len(b) + 1 + b.column(1).offset)[b.column(1).offset :]) if len(b) else []
        at, size = 0, 0
        for k, s in enumerate(sizes):
            size += int(s)
            if size >= limit or k == len(b) - 1:
                yield b.slice(at, k + 1 - at)
                at, size = k + 1, 0


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows where ``learn`` holds and text and language are there.

    The model has BUCKETS numbers a language, whatever the number of rows.
    """
    def count(batches):
        import pyarrow as pa

        total: dict[str, list[np.ndarray]] = {}
        for b in _batches(batches):
            codes, words, counts = _words(b.column(1))
            if not words:
                continue
            grams, of, n_letters, first = _grams(words)
            langs, of_doc = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            of_word = np.repeat(of_doc, counts)
            for k, lang in enumerate(langs.tolist()):
                times = np.bincount(codes[of_word == k], minlength=len(words))
                g, s = total.setdefault(lang, [np.zeros(BUCKETS), np.zeros(len(SCRIPT_NAMES))])
                g += np.bincount(grams, weights=times[of], minlength=BUCKETS)
                known = first >= 0
                s += np.bincount(first[known], weights=(times * n_letters)[known], minlength=len(SCRIPT_NAMES))
        for lang, (g, s) in total.items():
            all_ = np.concatenate([g, s]).astype(np.int64)
            at = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(all_[at])], names=["lang", "at", "n"])

    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, F.col(text_col).cast("string"))
    counts = rows.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    grid = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    grid[counts["at"].to_numpy(int), np.searchsorted(langs, counts["lang"].to_numpy(str)) if langs else []] = counts["n"]
    g, s = grid[:BUCKETS] + 0.5, grid[BUCKETS:]
    table = np.log(g / g.sum(axis=0)) if langs else g
    scripts = s >= SCRIPT_SHARE * s.sum(axis=0)
    scripts[~scripts.any(axis=1)] = True  # a script that no language has narrows nothing
    return Model(langs, (table - table.mean(axis=1, keepdims=True) if langs else table).astype(np.float32), scripts)


def word_scores(words: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, langs) scores, 0 for the best and at least -CLIP; letters of each word."""
    grams, of, n_letters, first = _grams(words)
    order = np.argsort(of, kind="stable")
    sums = np.zeros((len(words), len(m.langs)), np.float32)
    if len(of):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))
        sums[of[order][starts]] = np.add.reduceat(m.table[grams[order]], starts, axis=0)
    sums[~m.scripts[first] & (first >= 0)[:, None]] -= 1000
    return np.maximum(sums - sums.max(axis=1, keepdims=True), -CLIP), n_letters


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best states (steps, texts) for scores (steps, texts, states); a text that has
    ended goes on with scores of 0, which change nothing before its end."""
    steps, n, states = scores.shape
    stayed, best = np.empty((steps, n, states), bool), np.empty((steps, n), np.int8 if states < 128 else np.int32)
    v = scores[0].copy()
    for t in range(1, steps):
        best[t] = v.argmax(axis=1)
        move = (v.max(axis=1) - switch)[:, None]
        stayed[t] = v >= move
        v = np.maximum(v, move) + scores[t]
    path, rows = np.empty((steps, n), np.int64), np.arange(n)
    path[-1] = v.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = np.where(stayed[t, rows, path[t]], path[t], best[t])
    return path


def label(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``lang``, ``score`` and ``spans`` (lang, first word, words) of every whole text.

    Words are what white space parts; those without a letter belong to no span.
    ``lang`` is the language of most letters (ties: the first in order), ``score``
    its share of the letters.  Null and empty texts, texts without a letter, and all
    texts when nothing was learned give ``und``, 0 and no spans.  One row for each
    row, repeated rows too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def predict(batches):
        import pyarrow as pa

        m = shared.value
        span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
        for b in _batches(batches):
            codes, words, counts = _words(b.column(1))
            langs, score, spans = ["und"] * len(b), [0.0] * len(b), [[] for _ in range(len(b))]
            if words and m.langs:
                per_word, n_letters = word_scores(words, m)
                doc = np.repeat(np.arange(len(b)), counts)
                nth = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
                has = n_letters[codes] > 0
                codes, doc, nth = codes[has], doc[has], nth[has]
                n = np.bincount(doc, minlength=len(b))
                start = np.cumsum(n) - n
                order = [k for k in np.argsort(-n, kind="stable").tolist() if n[k]]
                while order:
                    steps = int(n[order[0]])
                    group, order = order[: max(1, CELLS // steps // len(m.langs))], order[max(1, CELLS // steps // len(m.langs)) :]
                    grid = np.zeros((steps, len(group), len(m.langs)), np.float32)
                    for j, k in enumerate(group):
                        grid[: n[k], j] = per_word[codes[start[k] : start[k] + n[k]]]
                    path = viterbi(grid)
                    for j, k in enumerate(group):
                        p = path[: n[k], j]
                        letters = np.bincount(p, weights=n_letters[codes[start[k] : start[k] + n[k]]], minlength=len(m.langs))
                        top = int(letters.argmax())
                        langs[k], score[k] = m.langs[top], float(letters[top] / letters.sum())
                        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                        firsts, lasts = nth[start[k] + cut], nth[start[k] + np.concatenate([cut[1:], [n[k]]]) - 1]
                        spans[k] = [{"lang": m.langs[p[c]], "first_word": int(f), "n_words": int(z - f + 1)} for c, f, z in zip(cut, firsts, lasts)]
            rest = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs), pa.array(score), pa.array(spans, pa.list_(span))], names=[*keep, "lang_pred", "score", "spans"])

    cols = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(cols[0], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), *cols[1:])
    types = docs.select(*cols).schema.simpleString()[7:-1]
    out = rows.mapInArrow(predict, f"{types}, lang_pred: string, score: double, spans: array<struct<lang:string,first_word:int,n_words:int>>")
    return out.withColumnRenamed("lang_pred", "lang") if "lang" not in keep else out
