"""What a Python worker takes at once, and what the pipeline shuffles to drop a few rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabvet.llm import common, toxicity
from tabvet.llm.common import sliced
from tabvet.llm.exact_dedup import FLUSH_BYTES, exact_duplicates
from tabvet.llm.minhash import _sets, _sketch


def batch(texts, kind, *between):
    ids = pa.array(range(len(texts)), pa.int64())
    columns = [ids, *between, pa.array(texts, kind)]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


TEXTS = [f"line {i} " + "some words of text " * 100 for i in range(4000)]  # 7.6 MB


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_string()])
def test_slices_have_all_rows_and_few_bytes(kind):
    texts = ["ab", "", "cdé", "x" * 50, "", "yz", ""]
    whole = batch([t.encode() for t in texts] if kind == pa.binary() else texts, kind)
    for b, want in ((whole, texts), (whole.slice(2), texts[2:]), (whole.slice(0, 0), [])):
        for limit in (1, 5, 1000):
            got = list(sliced([b, b], limit))
            out = [t if isinstance(t, str) else t.decode() for s in got for t in s.column(1).to_pylist()]
            assert out == want * 2 and all(len(s) for s in got)
            for s in got:  # without its last row a slice is below the limit
                assert sum(len(t) if isinstance(t, bytes) else len(t.encode()) for t in s.column(1).to_pylist()[:-1]) < limit


def test_stages_take_some_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    functions, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: functions.append(f) or real(self, f, *a, **b))
    model = toxicity.Model({"words": 3.0}, 1.0, 1.0, (-5.0, 1.0))
    toxicity.score(docs, model, keep=("doc_id", "text"))
    exact_duplicates(docs)
    predict, combine, _, digests = functions
    raw = [t.encode() for t in TEXTS]
    chars = pa.array([len(t) for t in TEXTS], pa.int64())
    asked = [
        (predict, batch(TEXTS, pa.string(), pa.array(TEXTS)), 1, toxicity.BATCH_BYTES),
        (combine, batch(raw, pa.binary(), chars), 2, FLUSH_BYTES),
        (digests, batch(raw, pa.binary()), None, 1_000_000), (_sketch(5), batch(raw, pa.binary()), None, 1_000_000), (_sets(5), batch(raw, pa.binary()), None, 1_000_000),
    ]
    for f, b, column, limit in asked:
        out = list(f(iter([b])))
        assert sum(len(x) for x in out) == len(TEXTS)
        most = limit + 3000
        if column is None:
            assert max(len(x) for x in out) * len(TEXTS[0]) <= most
        else:
            assert max(sum(map(len, x.column(column).to_pylist())) for x in out) <= most


def test_rows_are_not_shuffled_to_drop_a_few(spark, monkeypatch):
    """The dropped ids are written and broadcast by their counted rows; with too many, the join shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 40).alias("text"), F.lit("x").alias("lang"))
        docs = docs.unionByName(spark.createDataFrame([(None, "text 3", "y"), (None, None, "z")], "doc_id long, text string, lang string"))
        kept = {}
        for limit in (common.BROADCAST_BYTES, 0):
            monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
            out = corpus_pipeline.drop_copies(spark, docs.where("doc_id is not null"), "")
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert ("BroadcastHashJoin" in plan) == bool(limit) and ("SortMergeJoin" in plan) != bool(limit)
            kept[limit] = [sorted(map(str, o.collect())) for o in (out, corpus_pipeline.drop_copies(spark, docs, ""))]
        one, two = kept.values()
        assert one == two and len(one[0]) == 40 and len(one[1]) == 41
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
