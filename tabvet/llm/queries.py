"""Registered queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import language, quality, toxicity
from .common import table
from .decontaminate import UNITS, contamination
from .exact_dedup import exact_duplicates
from .flat_graph import near_vectors
from .merkle import manifest, verify
from .minhash import near_duplicates
from .packing import cut, pack
from .substring import dedup_units
from .suffix import repeated_strings
from .token_blocks import read_tokens, write_tokens
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress, digest, with_label_error


def held_out_fold(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    return dedup_units(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_units", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), spans.alias("removed_spans")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    items = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    all_ids = docs.select("doc_id").distinct()
    joined = all_ids.join(items.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("items"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), held_out_fold(4, 2)
    model = language.train(docs, ~held_out)
    return language.label(docs, model).select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(table(spark, sf_dir, "documents"))).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _learned_from(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out_fold(3, 1))
    return labels.select("doc_id", F.col(label).alias("label"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _learned_from(spark, sf_dir, "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, _learned_from(spark, sf_dir, "quality"))
    return quality.score(docs, net).select("doc_id", held_out_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tree = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": F.when(tampered, lower).otherwise(F.col("text"))})
    return verify(tree).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_line_dedup, op3_decontamination, op4_exact_dedup, op5_language_id, op6_best_fit_packing, op7_token_blocks,
    op8_toxicity, op9_quality, op10_minhash, op11_vector_codes, op12_flat_graph, op13_merkle)}


def _codes_sql() -> str:
    """Product codes: each round assigns all parts and takes means, one CTE a step."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    bad = "x IS NULL OR isnan(x) OR isinf(x)"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w,
            row_number() OVER (ORDER BY vec_id, embedding) AS nr FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: {bad})) = 0)""",
        f"parts AS MATERIALIZED (SELECT nr, part, list_slice(v, part * w + 1, part * w + w) AS x FROM kept, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, nr - 1 AS entry, x AS c FROM parts WHERE nr <= {ENTRIES})"]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT nr, part, arg_min(entry, k) AS entry, min(d) AS d, any_value(x) AS x FROM (SELECT nr, part, entry, x, d, d * {ENTRIES} + entry AS k FROM (SELECT nr, part, entry, x, {square} AS d FROM parts JOIN b{r} USING (part))) GROUP BY nr, part)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))")
    return f"""WITH {", ".join(steps)},
        e AS (SELECT nr, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY nr),
        s AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{ROUNDS}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN e USING (nr), s"""


def _forms(source: str, key: str, name: str) -> str:
    """SQL of the tokens and template tokens of a table."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return rf"""{name} AS (SELECT id, words, list_transform(words, lambda x: CASE
            WHEN regexp_matches(x, '^\p{{N}}') THEN '#n' WHEN regexp_matches(x, '^\p{{Lu}}') THEN '#p'
            WHEN x IN ({units}) THEN '#u' ELSE lower(x) END) AS forms
        FROM (SELECT {key} AS id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM {source}))"""


ORACLE = {
    "op11_vector_codes": _codes_sql(),
    "op12_flat_graph": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op2_line_dedup": r"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM t),
        w AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM u),
        d AS (SELECT *, norm <> '' AND (len(string_split(norm, ' ')) >= 4 OR length(norm) >= 40) AS counts, md5(norm) AS digest FROM w),
        r AS (SELECT *, counts AND row_number() OVER (PARTITION BY digest, counts ORDER BY doc_id, place) > 1 AS gone,
                     coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
              FROM d)
        SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256,
               coalesce(string_agg(begins::VARCHAR || ':' || length(line)::VARCHAR, ',' ORDER BY place) FILTER (gone), '') AS removed_spans
        FROM r GROUP BY doc_id""",
    "op3_decontamination": rf"""
        WITH {_forms("documents", "doc_id", "d")}, {_forms("benchmark", "item_id", "b")},
        ds AS (SELECT id, words, forms FROM d WHERE len(words) > 0),
        bs AS (SELECT id AS item_id, words AS iw, forms AS f, least(len(words), 8) AS size, len(words) - least(len(words), 8) + 1 AS n,
                      len(list_distinct(list_filter(forms, lambda x: x[1] <> '#'))) AS literals FROM b WHERE len(words) > 0),
        bw AS (SELECT item_id, size, j, w, f, list_transform(w, lambda x: lower(x)) AS low, hash(f) AS hf, hash(list_transform(w, lambda x: lower(x))) AS hl, len(list_filter(f, lambda x: x[1] <> '#')) < 2 AS sparse
               FROM (SELECT item_id, size, j, list_slice(iw, j + 1, j + size) AS w, list_slice(f, j + 1, j + size) AS f FROM (SELECT *, unnest(range(n)) AS j FROM bs))),
        dw AS MATERIALIZED (SELECT id, size, i, hash(list_slice(forms, i + 1, i + size)) AS hf, hash(list_slice(lows, i + 1, i + size)) AS hl
               FROM (SELECT *, unnest(range(len(forms) - size + 1)) AS i FROM (SELECT id, forms, list_transform(words, lambda x: lower(x)) AS lows FROM ds), (SELECT DISTINCT size FROM bs) WHERE len(forms) >= size)),
        found AS (SELECT id, i, item_id, j FROM dw JOIN bw USING (size, hl) UNION SELECT id, i, item_id, j FROM dw JOIN bw USING (size, hf) WHERE NOT sparse),
        lines AS (SELECT DISTINCT id, item_id, i - j AS shift FROM found),
        hits AS (SELECT * FROM found UNION SELECT id, shift + j, item_id, j FROM lines JOIN bw USING (item_id) WHERE sparse AND shift + j >= 0),
        cut AS (SELECT h.id, h.item_id, h.i - h.j AS shift, h.j, list_slice(words, h.i + 1, h.i + size) AS v, list_slice(forms, h.i + 1, h.i + size) AS vf, bw.w AS a, bw.f, bw.low, bw.size
                FROM hits h JOIN bw USING (item_id, j) JOIN ds ON ds.id IS NOT DISTINCT FROM h.id),
        m AS (SELECT id, item_id, shift, j, list_transform(v, lambda x: lower(x)) = low AS exact, v, a, f, size FROM cut WHERE list_transform(v, lambda x: lower(x)) = low OR vf = f),
        p AS (SELECT *, exact OR 2 * len(list_filter(f, lambda x: x[1] = '#')) <= size AS plain FROM m),
        slots AS (SELECT DISTINCT id, item_id, shift, a, v, plain FROM (SELECT id, item_id, shift, plain, unnest(f) AS x, unnest(a) AS a, unnest(v) AS v FROM p) WHERE x[1] = '#'),
        steady AS (SELECT id, item_id, shift, max(k) <= 1 AS all_steady, max(kp) <= 1 AS plain_steady
                   FROM (SELECT id, item_id, shift, a, count(DISTINCT v) AS k, count(DISTINCT v) FILTER (plain) AS kp FROM slots GROUP BY ALL) GROUP BY ALL),
        line AS (SELECT p.id, p.item_id, p.shift, coalesce(any_value(all_steady), true) AS all_steady, coalesce(any_value(plain_steady), true) AS plain_steady,
                        list(DISTINCT j) AS js, coalesce(list(DISTINCT j) FILTER (plain), []) AS plain, coalesce(list(DISTINCT j) FILTER (exact), []) AS exact
                 FROM p LEFT JOIN steady s ON s.id IS NOT DISTINCT FROM p.id AND s.item_id = p.item_id AND s.shift = p.shift GROUP BY p.id, p.item_id, p.shift),
        judged AS (SELECT line.id, item_id, n, CASE WHEN all_steady AND len(js) = n AND literals >= 2 THEN js WHEN plain_steady THEN plain ELSE exact END AS counted,
                          CASE WHEN all_steady AND len(plain) > 0 THEN list_filter(js, lambda x: NOT list_contains(plain, x)) ELSE [] END AS unsure FROM line JOIN bs USING (item_id)),
        sums AS (SELECT id, item_id, n, list_distinct(flatten(list(counted))) AS counted, list_distinct(flatten(list(unsure))) AS unsure FROM judged GROUP BY id, item_id, n),
        hit AS (SELECT id, item_id FROM sums WHERE len(counted) > 0 AND len(counted) / (n - len(list_filter(unsure, lambda x: NOT list_contains(counted, x)))) >= 0.5)
        SELECT doc_id, count(item_id) > 0 AS contaminated, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN hit ON doc_id IS NOT DISTINCT FROM id GROUP BY doc_id""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        d AS (SELECT doc_id, length(x) AS chars, sha256(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
