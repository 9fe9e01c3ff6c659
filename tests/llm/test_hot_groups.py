"""Groups that grow: near copies that are not similar, rows of capitals, words made to collide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.llm import decontaminate as D
from tabvet.llm import minhash as M
from tabvet.llm.decontaminate import contamination
from tabvet.llm.links import components
from tabvet.llm.minhash import near_duplicates
from tabvet.llm.words import word_hashes


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_under_a_polynomial_hash(spark):
    for n in (1024, 2048):  # vectorised up to 512 bytes, BLAKE2 beyond; both lengths collided before
        docs = spark.createDataFrame([(1, thue_morse(n, "a", "b")), (2, thue_morse(n, "b", "a"))], "doc_id long, text string")
        assert [r["component_id"] for r in sorted(near_duplicates(docs).collect())] == [1, 2]
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abß"), k)) for k in rng.integers(1, 40, 20_000)} | {"a" * k for k in range(1, 700)} | {thue_morse(k, x, y) for k in (64, 128, 256, 512) for x, y in ("ab", "ba")})
    hashes, ends = word_hashes([w.encode() for w in words])
    assert len(set(hashes.tolist())) == len(words) == len(hashes) and ends.tolist() == list(range(1, len(words) + 1))
    alone = [word_hashes([w.encode()])[0][0] for w in words[:200]]
    assert alone == hashes[:200].tolist()  # whatever stands before or after


def test_large_group_whose_members_are_not_all_similar(spark, monkeypatch):
    """One base text with changes spread so that many pairs share buckets without a link."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(150):
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            words[p] = f"x{rng.integers(0, 4)}"
        texts.append(" ".join(words))
    texts += texts[:30]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    linked = apart = 0
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
            else:
                apart += 1
    assert linked > 500 and apart > 500 and len({top(k) for k in range(len(texts))}) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == {k: top(k) for k in range(len(texts))}


def test_components_of_a_star_a_chain_and_rings(spark):
    rng = np.random.default_rng(4)
    links = [(5000, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(6000, 6400)] + [(7000 + k, 7000 + (k + 1) % 50) for k in range(50)]
    links = [links[k] for k in rng.permutation(len(links))]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {5000: 1, **{k: 1 for k in range(1, 3000)}, **{k: 6000 for k in range(6000, 6401)}, **{k: 7000 for k in range(7000, 7050)}}
    assert got == want


def _hits(spark, monkeypatch, docs, items):
    rows, stored = {}, D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: rows.setdefault(name, stored(df, name)))
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return rows["hits"].count(), sorted((r["doc_id"], r["item_id"]) for r in found)


def test_rows_of_capitals_do_not_meet_every_window(spark, monkeypatch):
    caps = lambda n, s: " ".join(f"N{s}x{k}" for k in range(n))
    items = [(k, caps(40, k)) for k in range(20)]
    docs = [(1, caps(1000, 99)), (2, f"{caps(500, 98)} {caps(40, 3)} {caps(500, 97)}"), (3, caps(40, 5).lower())]
    n, found = _hits(spark, monkeypatch, docs, items)
    assert found == [(2, 3), (3, 5)] and n <= 2 * 33


def test_sparse_windows_count_beside_others(spark, monkeypatch):
    names = lambda s: " ".join(f"{w}{s}" for w in "Anna Bert Cleo Dora Emil Fred Gina Hugo Ivan Jane".split())
    item = f"the miller asked why {names('a')} had left"
    docs = [(1, f"the miller asked why {names('b')} had left"), (2, f"so {names('b')} and others"), (3, item.upper()), (4, f"the miller asked why {names('b')} had gone")]
    n, found = _hits(spark, monkeypatch, docs, [(9, item)])
    assert found == [(1, 9), (3, 9), (4, 9)]


@pytest.mark.parametrize("n", [0, 1])
def test_no_links(spark, n):
    docs = spark.createDataFrame([(k, "one text only here now") for k in range(n)], "doc_id long, text string")
    assert near_duplicates(docs).count() == n and contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == 0


CLASHING = "doc_id long, text string, label int, score double, passages string, _text string, _row int, _key int, _id int, _h int, c0 int, keep_id int, lang string, words int"


def test_columns_named_as_inner_ones(spark, tmp_path):
    """Every operator and stage on columns that it could mistake for its own, with repeated rows."""
    import corpus_pipeline as P
    from tabvet.llm import language, quality, toxicity
    from tabvet.llm.exact_dedup import exact_duplicates
    from tabvet.llm.packing import cut, pack
    from tabvet.llm.substring import dedup_units
    from tabvet.llm.suffix import repeated_strings
    from tabvet.llm.token_blocks import read_tokens, write_tokens

    words = lambda k, n: " ".join(f"w{(k * 7 + i * i) % 97}" for i in range(n))
    rows = [(k, f"{'vile ' * (k % 2)}{words(k, 30)}") for k in range(40)] + [(3, f"vile {words(3, 30)}"), (None, None), (50, ""), (51, words(51, 4000))]
    docs = spark.createDataFrame([(i, t, 9, 0.5, "p", "t", 1, 2, 3, 4, 5, 6, "aa" if k % 3 else "bb", 7) for k, (i, t) in enumerate(rows)], CLASHING)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    labels.select("doc_id", F.col("label").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(5, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n, distinct = len(rows), len(set(rows))
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
    assert quality.score(docs, quality.train(docs, labels)).count() == n
    assert language.label(docs, language.train(docs, F.lit(True))).count() == n
    assert pack(cut(docs)).select("doc_id").distinct().count() == len({i for i, _ in rows})
    for operator in (exact_duplicates, near_duplicates, dedup_units, repeated_strings):
        assert operator(docs).count() == distinct, operator
    write_tokens(docs, f"{tmp_path}/tokens")
    assert read_tokens(spark, f"{tmp_path}/tokens").count() == distinct
    assert contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text", "label")).count() > 0
    for name, stage in P.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns and 0 < left.count() <= n and left.first()["_row"] == 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert P.pack_sequences(spark, docs, str(tmp_path)).count() >= n


def test_links_inside_components_take_no_part_in_later_joins(spark, monkeypatch):
    from tabvet.llm import links as L

    rng = np.random.default_rng(8)
    ends, make = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name, **kw: (ends.append(make(df, name, **kw)) or ends[-1]) if name == "ends" else make(df, name, **kw))
    all_links, labels, sizes = [], None, []
    # a first star of 300, then its 20,000 pairs, then links of it to others, new ones among them
    rounds = [[(1, k) for k in range(2, 301)] + [(400, 401), (500, 501)], [tuple(x) for x in rng.integers(1, 301, (20_000, 2)).tolist() if x[0] != x[1]] + [(401, 500)],
              [(int(k), 501) for k in rng.integers(1, 301, 500)] + [(900, 0), (901, 902)], [(902, 902), (1, 300)]]
    for new in rounds:
        more = spark.createDataFrame(new, "a long, b long")
        labels = components(more) if labels is None else L.joined(labels, more)
        sizes.append(ends[-1].count())
        all_links += new
        want = dict(tuple(r) for r in components(spark.createDataFrame(all_links, "a long, b long")).collect())
        ends.pop()
        got = [tuple(r) for r in labels.collect()]
        assert dict(got) == want and len(got) == len(want)
    assert sizes[0] > 600 and max(sizes[1:]) <= 12


def test_later_links_are_joined_to_components(spark, monkeypatch):
    """The components of all links, of which a dense group has many, are not made anew in each round."""
    monkeypatch.setattr(M, "PAIRS_PER_DOC", 10**6)  # the rest of the first star as pairs
    seen, of = [], M.components
    monkeypatch.setattr(M, "components", lambda links: seen.append(links.count()) or of(links))
    rng = np.random.default_rng(12)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(80):
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            words[p] = f"x{rng.integers(0, 4)}"
        texts.append(" ".join(words))
    near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(seen) == 1 and seen[0] > 0


def test_a_long_run_is_compared_some_places_at_a_time(spark, monkeypatch):
    """Many texts around one common passage: one run of leads, in bounded pieces, with the same bytes removed."""
    import pyarrow as pa

    from tabvet.llm import suffix as S

    rng = np.random.default_rng(3)
    line = bytes(rng.integers(97, 123, 140).astype(np.uint8))
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    texts = [noise(int(rng.integers(0, 90))) + line[: int(rng.integers(60, 141))] + noise(int(rng.integers(10, 120))) for _ in range(400)]
    of, lead0, lead1, ctx, span = S.anchored(texts)
    lo, hi = S._back(span)
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in (lead0, lead1, of, span)), pa.array([texts[k][a : z + S.LENGTH] for k, a, z in zip(of.tolist(), lo.tolist(), hi.tolist())], pa.binary())],
                                       names=["lead0", "lead1", "_id", "span", "body"])
    windows, sizes = S._windows, []
    monkeypatch.setattr(S, "_windows", lambda *a: (lambda out: sizes.append(len(out[0])) or out)(windows(*a)))
    rows = lambda: sorted(r for b in S._compare_windows([batch]) for r in zip(*(c.to_pylist() for c in b.columns)))
    want, whole = rows(), max(sizes)
    sizes.clear()
    monkeypatch.setattr(S, "WINDOWS", 500)
    assert rows() == want and len(want) > 1000
    assert whole > 5000 and max(sizes) < 1000
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in S.repeated_strings(spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)).collect()}
    seen = set()
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - S.LENGTH + 1):
            w = t[p : p + S.LENGTH]
            if w in seen:
                gone[p : p + S.LENGTH] = True
            seen.add(w)
        assert got[k] == (int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes())
