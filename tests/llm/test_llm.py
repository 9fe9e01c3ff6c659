"""Operators of tabvet.llm against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scripts.compare import compare
from tabvet.llm import queries as Q
from tabvet.llm import packing, token_blocks
from tabvet.llm.common import outer_id
from tabvet.llm.decontaminate import contamination
from tabvet.llm.exact_dedup import Trie, better, exact_duplicates
from tabvet.llm.language import label, train
from tabvet.llm.minhash import near_duplicates
from tabvet.llm.packing import best_two_fit, cut, pack
from tabvet.llm.substring import dedup_units
from tabvet.llm.suffix import multikey_quicksort, repeated_strings
from tabvet.llm.tokens import Encoder, vocabulary
from tabvet.llm.toxicity import segments, train as train_toxicity

from ..conftest import SF_SMALL

SCHEMA = "doc_id long, text string, _id int, body string, score double, label string"


@pytest.fixture(scope="module")
def corpus():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_SMALL}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, and columns named as the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "one two"), (None, "a b c d e f"), (4, long), (5, long), (6, "same row here now"), (6, "same row here now"), (7, " \n\t ")]
    return spark.createDataFrame([(i, t, 1, "x", 0.5, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(n for n in Q.ORACLE))
def test_oracle(spark, name):
    r = compare(spark, SF_SMALL, name, Q.QUERIES[name], Q.ORACLE[name])
    assert r["ok"] and r["rows"] > 0, r


def test_suffixes_against_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in Q.op1_suffix_dedup(spark, SF_SMALL).collect()}
    seen: set[bytes] = set()
    for doc in sorted(corpus):
        b = corpus[doc].encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        assert (got[doc]["n_bytes"], got[doc]["n_removed"], got[doc]["kept_sha256"]) == (len(b), sum(cover), hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 9, 50_000) for _ in range(4)]
    order = multikey_quicksort(keys)
    assert sorted(zip(*keys)) == list(zip(*(k[order] for k in keys)))


def test_minhash_against_brute_force(spark, corpus):
    sets = {}
    for doc, text in corpus.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        sets[doc] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    shared: Counter = Counter()
    holders = defaultdict(list)
    for doc, s in sets.items():
        for g in s:
            shared.update((o, doc) for o in holders[g])
            holders[g].append(doc)
    up = {d: d for d in sets}

    def top(d):
        return d if up[d] == d else top(up[d])

    for (a, b), n in shared.items():
        if 100 * n >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    for r in Q.op10_minhash(spark, SF_SMALL).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]))


def test_trie_spills_by_subtree():
    rng = np.random.default_rng(2)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 12)).astype(np.uint8)) for _ in range(3000)]
    trie, want = Trie(limit=20_000), {}
    for k, key in enumerate(keys):
        value = (int(rng.integers(0, 5)), k, 1)
        trie.insert(key, value)
        want[key] = better(want[key], value) if key in want else value
    assert dict(trie.items()) == want


def test_tokens_and_blocks(spark, corpus):
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(" \n\tab1.'s é\x1c<|　"), rng.integers(0, 14))) for _ in range(2000)]
    texts += ["<|endoftext|> it's", "x   y\n\n z", *list(corpus.values())[:50]]
    want = [np.asarray(e.ids + [2], "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(vocabulary(), 2).encode(texts) == want
    for n in (0, 1, 127, 128, 129, 1000):
        x = rng.integers(0, 2**32, n).astype(np.uint32)
        docs, lengths, ids = token_blocks.read_segment(token_blocks.write_segment(np.array([5]), np.array([n], np.uint32), x))
        assert docs.tolist() == [5] and lengths.tolist() == [n] and (ids == x).all()
    start = 0
    for r in sorted(Q.op7_token_blocks(spark, SF_SMALL).collect()):
        ids = np.asarray(tok.encode(corpus[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1025, 5000).tolist()
    bins = best_two_fit(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in bins) and len(bins) <= 1.02 * sum(lengths) / 1024 + 1
    ends: dict = defaultdict(int)
    for r in sorted(Q.op6_best_fit_packing(spark, SF_SMALL).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


def test_segments():
    # two hits joined over a short gap, one apart
    assert [(f, z) for f, z, _ in segments([3, 5, 900], [2.0, 2.0, 2.0], drift=-0.1)] == [(3, 5), (900, 900)]
    assert segments([], []) == []


@pytest.mark.parametrize("name,label_col,least", [("op8_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.95)])
def test_held_out_labels(spark, name, label_col, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label_col).alias("y"))
    got = Q.QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id").where("y is not null").agg(F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
    assert got >= least


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = Q.op5_language_id(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got >= 0.98


def test_mixed_languages_and_no_letters(spark):
    words = {"aa": "foo bar baz fob", "bb": "xin yuq zix quy"}
    docs = spark.createDataFrame([(k, words[lang], lang) for k, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    model = train(docs, F.lit(True))
    mixed = spark.createDataFrame([(1, "foo bar " * 20 + "xin yuq " * 9), (2, "12 !"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in label(mixed, model).collect()}
    assert got[1]["lang"] == "aa" and [(s["lang"], s["first_word"], s["n_words"]) for s in got[1]["spans"]] == [("aa", 0, 40), ("bb", 40, 18)]
    assert got[2]["lang"] == got[3]["lang"] == "und" and got[3]["score"] == 0


def test_templates_and_slots(spark):
    item = "Anna bought 12 apples for 3 dollars and then gave 12 apples to her old friend"
    other = "Berta bought 40 apples for 7 dollars and then gave 40 apples to her old friend"
    docs = spark.createDataFrame([(1, "so " + item), (2, "so " + other), (3, other.replace("gave 40", "gave 41")), (4, "nothing here"), (5, None)], "doc_id long, text string")
    found = contamination(docs, spark.createDataFrame([(9, item), (8, "")], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 9), (2, 9)]


OPERATORS = {
    "suffix": repeated_strings, "substring": dedup_units, "exact": exact_duplicates, "minhash": near_duplicates,
    "packing": lambda d: pack(cut(d)).groupBy("doc_id").count(),
    "decontaminate": lambda d: contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")).select("doc_id").distinct(),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    ids = [r["doc_id"] for r in OPERATORS[name](odd).collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {None, 1, 2, 3, 4, 5, 6, 7}
    if name != "decontaminate":
        assert len(ids) == 8  # the repeated row is one document
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_odd_rows_have_their_results(spark, odd):
    exact = {r["doc_id"]: r["keep_id"] for r in exact_duplicates(odd).collect()}
    assert exact[5] == 4 and exact[2] == exact[1] == exact[7] == 7  # of empty texts the longest
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(odd).collect()}
    assert near[5] == 4 and near[1] == 1 and near[2] == 2 and near[None] is None


def test_pipeline(spark):
    import corpus_pipeline as P

    left = {r["doc_id"] for r in P.run(spark, SF_SMALL).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert 0 < len(left) < docs.count() and outer_id is not None
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == columns, name


def test_contamination_in_another_letter_case(spark):
    item = "The quick brown fox jumps over a lazy dog while Anna and Berta watch from the old wooden bridge"
    docs = spark.createDataFrame([(1, item.upper()), (2, "so " + item.lower()), (3, item), (4, "NOTHING OF THIS KIND IS IN HERE AT ALL")], "doc_id long, text string")
    found = contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["share"]) for r in found.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_labelled_texts_with_a_common_passage_all_count(spark):
    common = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(k, f"{common} {'vile' if k % 2 else 'nice'} t{k}") for k in range(80)], "doc_id long, text string")
    model = train_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("label")))
    assert "vile" in model.scores and "nice" not in model.scores


def test_texts_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    import corpus_pipeline as P

    texts = [(None, "the first of three texts without an id"), (None, "and a second one that is nothing like it"), (None, "and a second one that is nothing like it"),
             (None, ""), (7, "seven has two texts and this is one"), (7, "while that is the other of them"), (8, "while that is the other of them")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    distinct = sorted(set(texts), key=str)
    assert sorted([(r["doc_id"], r["kept"]) for r in dedup_units(docs).collect()], key=str) == sorted([(i, t if i != 8 else "") for i, t in distinct], key=str)
    assert sorted((r["n_bytes"] for r in repeated_strings(docs).collect())) == sorted(len(t) for _, t in distinct)
    exact = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_duplicates(docs).collect()]
    near = [(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()]
    assert sorted(exact, key=str) == sorted([(None, None, 1)] * 3 + [(7, 7, 1), (7, 7, 2), (8, 7, 2)], key=str)
    assert sorted(near, key=str) == sorted([(None, None)] * 3 + [(7, 7), (7, 7), (8, 7)], key=str)
    token_blocks.write_tokens(docs, str(tmp_path / "tokens"))
    assert sorted(r["doc_id"] or 0 for r in token_blocks.read_tokens(spark, str(tmp_path / "tokens")).collect()) == [0, 0, 0, 7, 7, 8]
    found = contamination(docs, spark.createDataFrame([(1, texts[0][1]), (1, texts[1][1])], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(None, 1)] * 2
    left = [tuple(r) for r in P.drop_near_copies(spark, P.drop_copies(spark, docs, ""), "").collect()]
    assert sorted(left, key=str) == [x for x in distinct if x[0] != 8]


def test_windows_dense_with_slots(spark):
    prose = "the farmer walks to the market with some baskets of fresh fruit and"
    names = lambda words, n: " ".join(f"{w} {n + k}" for k, w in enumerate(words.split()))
    items = [(1, "What is 12 plus 15 times 3"), (2, "New York City Hall"), (3, f"{prose} {names('Anna Berta Carla Dora Emma Fiona Greta Hanna', 20)}")]
    docs = [(1, "so What is 40 plus 7 times 9 and more"), (2, "What is 40 minus 7 times 9"), (3, "Old Paris Town House"), (4, f"{prose} {names('Paul Otto Max Leo Jan Tom Ben Tim', 50)}"),
            (5, f"{prose} {names('Paul Otto Max Leo', 50)} and so on"), (6, prose), (7, "What is 12 plus 15 times 3")]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (4, "Who is 5 plus 5 times 3")], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (4, 3), (5, 3), (7, 1)]


def test_long_lines_without_spaces(spark):
    line = "这一行没有空格" * 8
    docs = spark.createDataFrame([(1, f"{line}\nkurz"), (2, f"kurz\n{line}")], "doc_id long, text string")
    assert [(r["doc_id"], r["n_removed"], r["kept"]) for r in sorted(dedup_units(docs).collect())] == [(1, 0, f"{line}\nkurz"), (2, 1, "kurz")]
    assert sum(r["n_removed"] for r in dedup_units(docs, min_words=1).collect()) == 2


def test_strings_of_added_tokens(spark):
    tok = Tokenizer.from_file(vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's  <|endoftext|>\nx", "no such string"]
    want = [zlib.crc32(np.asarray(e.ids + [2], "<u4").tobytes()) for e in tok.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["ids_crc32"] for r in sorted(cut(docs).collect())] == want


def test_equal_pieces_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    pieces = spark.range(2000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1 as length", "5L as ids_crc32")
    rows = pack(pieces).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 2000 and max(groups.values()) < 200


def test_planted_rows_go_at_their_stage(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    text = lambda n=60: " ".join(f"word{i}" for i in rng.integers(0, 500, n))
    clean, toxic = {k: text() for k in range(40)}, {k: f"{text(30)} vile vile {text(30)}" for k in range(100, 140)}
    item = "Anna asked why the old mill by the river had stood without a miller since the war"
    rows = [*clean.items(), *toxic.items(), (200, clean[0]), (201, f"{clean[1]} more"), (202, item.upper()), (None, f"{text(9)} {item}"), (None, text())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 100)) for k in (*clean, *toxic)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [set(toxic), {200}, {201}, {202}, set()]
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), {k for k, _ in rows}
    for (name, stage), ids in zip(P.STAGES, gone):
        docs, want = P.stored(stage(spark, docs, str(tmp_path)), name), want - ids
        left = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(left) == want and left.count(None) == (2 if name in ("toxicity", "exact_dedup", "near_dedup") else 1), name
    found = {r["doc_id"]: r["items"] for r in Q.op3_decontamination(spark, str(tmp_path)).collect() if r["contaminated"]}
    assert found == {202: "5", None: "5"}
