"""Vector codes, flat graph and Merkle manifest against brute force, and on odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.llm import flat_graph as G
from tabvet.llm import merkle, vector_codes
from tabvet.llm import queries as Q

from ..conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, v int, rep string, digest int, _label int, n long, doc_id int, x int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, odd components, ties, repeated rows, two lengths, and columns named as the operators' own."""
    rng = np.random.default_rng(5)
    base = [float(z) for z in rng.normal(size=16)]
    rows = [(1, base, 1), (2, base, None), (2, base, None), (3, None, 1), (4, [None, *base[1:]], 2), (5, [float("nan"), *base[1:]], 2), (6, [float("inf"), *base[1:]], 2),
            (7, [0.0] * 16, None), (8, [], 3), (None, [2 * z for z in base], 3), (None, None, 3), (9, base[:8], 3), (10, [-z for z in base], 1), (11, base[:3], 1)]
    return spark.createDataFrame([(i, v, y, 1, "a", 2, 3, 4, 5, 6) for i, v, y in rows], VECTORS)


def test_nearest_against_all_distances():
    rng = np.random.default_rng(1)
    for width, high in ((1, 4), (3, 3), (8, 4096)):  # few values: many ties and equal entries
        parts, books = rng.integers(-high, high, (500, 4, width)), rng.integers(-high, high, (4, 16, width))
        d = ((parts[:, :, None] - books[None]) ** 2).sum(axis=3)
        best, dist = vector_codes.nearest(parts, books)
        assert (best == d.argmin(axis=2)).all() and (dist == d.min(axis=2)).all()


def test_odd_vectors_have_their_codes(spark, odd_vectors):
    codes, books = vector_codes.compress(odd_vectors)
    got = vector_codes.with_label_error(codes).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 2, 2, 7, 10]  # 8, 9 and 11 have another length
    assert books.shape == (8, 6, 2) and all(r["error"] == 0 and r["code"] == "".join(r["code"][:2] for _ in range(8)) for r in got if r["vec_id"] == 1)
    by_label = {}
    for r in got:
        by_label[r["label"]] = by_label.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in got)
    empty, none = vector_codes.compress(odd_vectors.limit(0))
    assert vector_codes.with_label_error(empty).count() == 0 and none.size == 0
    with pytest.raises(Exception, match="out of range"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int"))[0].collect()


def _links(x):
    u = G.unit(x)
    return (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)


def _components(linked):
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None], len(label)).min(axis=1))
        if (low == label).all():
            return label
        label = low


def test_flat_graph_against_all_pairs(spark, monkeypatch):
    """Small bounds, so clusters have several graphs and blocks; one group holds a third."""
    for name, value in (("CLUSTER", 100), ("NODES", 80), ("QUERIES", 70)):
        monkeypatch.setattr(G, name, value)
    rng = np.random.default_rng(7)
    centre, chain = rng.normal(size=24), np.linspace(0, np.pi / 2, 12)
    hot = centre + 0.11 * rng.normal(size=(300, 24))
    small = np.repeat(rng.normal(size=(40, 24)), 4, axis=0) + 0.12 * rng.normal(size=(160, 24))
    arc = np.zeros((12, 24))
    arc[:, 0], arc[:, 1] = np.cos(chain), np.sin(chain)  # each like the next only
    x = np.concatenate([hot, small, arc, hot[:20], rng.normal(size=(300, 24))]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    linked = _links(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: r for r in G.near_vectors(df).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    label = np.array([got[i]["component_id"] for i in range(len(x))])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.98 * linked.sum() > 1000
    assert (label == _components(linked)).mean() >= 0.99 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_robust_prune_keeps_the_nearest_and_spreads():
    rng = np.random.default_rng(2)
    x = G.unit(rng.normal(size=(200, 8)))
    pool = G._nearest_first(x, np.arange(200), *np.divmod(np.arange(200 * 200), 200))
    out = G.robust_prune(x, np.arange(200), pool)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    for p in range(200):
        left, want = [c for c in pool[p] if c != p], []
        while left and len(want) < G.DEGREE:
            want.append(left[0])
            left = [c for c in left[1:] if G.ALPHA * d[want[-1], c] > d[p, c]]
        assert out[p][out[p] >= 0].tolist() == want


def test_recall_that_falls_short_widens_the_search(spark, monkeypatch):
    tried, searched = [], G._searched
    monkeypatch.setattr(G, "CLUSTER", 40)
    monkeypatch.setattr(G, "_searched", lambda *a: tried.append(a[3]) or searched(*a))
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(150, 8)), 2, axis=0) + 0.15 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n = sum(r["n_links"] for r in G.near_vectors(df, probes=1, least_recall=1.0).collect())
    assert len(tried) > 1 and n >= 0.98 * _links(x).sum()


def test_odd_vectors_have_their_links(spark, odd_vectors):
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in G.near_vectors(odd_vectors).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    # ids repeat, so two rows without an id are two; the one like 1 and 2 comes first
    assert got == sorted([*alone, (1, 2, None, False), (2, 2, None, False), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert G.near_vectors(odd_vectors.limit(0)).count() == 0
    assert G.near_vectors(odd_vectors.where("vec_id = 7")).count() == 1


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """Levels from the foot to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][s : s + 8]) for s in range(0, len(levels[-1]), 8)])
    return levels


def _brute(rows, changed):
    """Every column of the result by rebuilding the path of each leaf; rows(id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(enc, r))
    langs = sorted({r[2] for r in rows}, key=lambda v: b"" if v is None else b"=" + v.encode())
    by_lang = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: _tree([leaf(r) for r in rs]) for g, rs in by_lang.items()}
    top = _tree([trees[g][-1][0] for g in langs])
    out = []
    for g, rs in by_lang.items():
        for i, r in enumerate(rs):
            digest, proof = leaf(changed(r)), []
            for levels, at in ((trees[g], i), (top, langs.index(g))):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += [x for k, x in enumerate(run) if k != at % 8]
                    run[at % 8] = digest
                    digest, at = H(*run), at // 8
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def _tampered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None:
        return r
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))


def _manifest(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tree = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": F.when(hit, lower).otherwise(F.col("text"))})
    return sorted((tuple(r) for r in merkle.verify(tree).collect()), key=str)


def test_manifest_against_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, source, lang, n_chars, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    got = Q.op13_merkle(spark, SF_SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == _brute(rows, _tampered) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513, 4097])
def test_manifest_of_many_shapes(spark, n):
    """Trees of one to five levels, several rounds of blocks, ten small trees beside a large one."""
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(n)] + [(n + k, "s", f"l{k}", None, "É a") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _manifest(docs) == _brute(rows, _tampered)


def test_odd_rows_have_their_leaves(spark):
    rows = [(1, None, None, None, None), (None, "", "", 0, ""), (None, "", "", 0, ""), (None, "b", "", 0, "Ä"), (2, "x", "en", 3, "word " * 50_000), (2, "x", "en", 4, "A"), (3, None, "é", -5, "B"), (3, None, "é", -5, "B")]
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, id int, tree string, nr int, pos int, leaf int, n int")
    assert _manifest(docs) == _brute(rows, _tampered)
    assert _manifest(docs.limit(0)) == []


def test_parent_resumes_its_states():
    children = [H(str(k)).encode() for k in range(8)]
    parent = merkle.Parent(children)
    for slot in range(8):
        want = [*children[:slot], b"x" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"x" * 64) == hashlib.sha256(b"".join(want)).hexdigest().encode()
