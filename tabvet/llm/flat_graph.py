"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rownum import number_rows
from .common import NULL_ID, outer_id, salted_join, stored, with_ids
from .links import components
from .vector_codes import valid

#: Centroids are fitted on so many vectors, and so many components in all, at most.
SAMPLE, SAMPLE_VALUES = 16_384, 2**21
#: Members of a cluster that the number of clusters aims at, and the most clusters.
CLUSTER, MAX_CLUSTERS = 1024, 4096
#: Nodes of a graph and queries of a task; a larger cluster has several graphs, all searched.
NODES, QUERIES = 2048, 2048
#: Clusters that a vector is in, and those that it is searched in at first.
MEMBERS, PROBES = 2, 6
#: Out-degree, candidates of a prune, beam, nodes that a step expands, and the prune's slack.
DEGREE, POOL, BEAM, WIDTH, ALPHA = 24, 64, 32, 4, 1.2
#: Nodes down to so much under the threshold are expanded too.
REACH = 0.05
#: Vectors compared with all others to measure the recall, and the least recall.
AUDIT, LEAST_RECALL = 512, 0.98
_CHUNK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, within: float | None = None) -> np.ndarray:
    """(queries, nodes) cosines that a greedy search from ``starts`` has seen, -inf elsewhere.

    ``graph`` has the neighbours of each node, -1 for none.  The WIDTH best nodes of the beam
    that were not expanded are, until the BEAM best all were.  With ``within``, the range then
    grows: every node that near is expanded, until no new one turns up.
    """
    n, nodes = len(q), len(x)
    seen = np.full((n, nodes), -np.inf)
    done = np.zeros((n, nodes), bool)
    rows = np.arange(n)
    seen[:, starts] = q @ x[starts].T

    def expand(row: np.ndarray, node: np.ndarray) -> None:
        done[row, node] = True
        to = graph[node]
        flat = (row[:, None] * nodes + to)[to >= 0]
        flat = np.unique(flat[seen.ravel()[flat] == -np.inf])
        a, b = np.divmod(flat, nodes)
        seen[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    beam = min(BEAM, nodes)
    while len(rows):
        best = np.argpartition(-seen[rows], beam - 1, axis=1)[:, :beam]
        score = np.take_along_axis(seen[rows], best, axis=1)
        score[np.take_along_axis(done[rows], best, axis=1)] = -np.inf
        pick = np.argsort(-score, axis=1)[:, :WIDTH]
        there = np.take_along_axis(score, pick, axis=1) > -np.inf
        node = np.take_along_axis(best, pick, axis=1)
        rows, row, node = rows[there.any(axis=1)], np.repeat(rows, there.sum(axis=1)), node[there]
        if len(row):
            expand(row, node)
    if within is not None:
        while True:
            row, node = np.nonzero((seen >= within) & ~done)
            if not len(row):
                break
            for s in range(0, len(row), 50_000):
                expand(row[s : s + 50_000], node[s : s + 50_000])
    return seen


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """(points, degree) neighbours out of ``pool`` (points, candidates), nearest first, -1 for none.

    The nearest candidate becomes a neighbour and rules out those that are ``alpha`` times
    nearer to it than to the point; and so on with what is left.
    """
    near = 1 - np.einsum("pd,pcd->pc", x[points], x[pool])
    between = 1 - np.einsum("pcd,ped->pce", x[pool], x[pool])
    alive = pool >= 0
    alive &= pool != points[:, None]
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = pool[rows, first][some]
        alive &= alpha * alpha * between[rows, first] > near
        alive[rows, first] = False
    return out


def _nearest_first(x: np.ndarray, points: np.ndarray, owner: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(points, POOL) the nearest distinct ``other`` of each of ``points``, given as pairs by place."""
    pair = np.unique(owner * len(x) + other)
    owner, other = np.divmod(pair, len(x))
    score = np.einsum("ij,ij->i", x[points[owner]], x[other])
    order = np.lexsort((other, -score, owner))
    owner, other = owner[order], other[order]
    starts = np.searchsorted(owner, np.arange(len(points)))
    rank = np.arange(len(owner)) - starts[owner]
    pool = np.full((len(points), POOL), -1)
    pool[owner[rank < POOL], rank[rank < POOL]] = other[rank < POOL]
    return pool


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Graph (nodes, DEGREE) over unit vectors and the medoids where searches start.

    Nodes come in batches that double.  Each is searched for in the graph so far; what the
    search saw, with the batch's own nodes, is pruned to its neighbours, and these get an
    edge back and are pruned if they have too many.
    """
    n = len(x)
    thirds = np.array_split(np.arange(n), min(8, n))
    starts = np.unique([part[np.argmax(x[part] @ x[part].mean(axis=0))] for part in thirds])
    graph = np.full((n, DEGREE), -1)
    rest = np.setdiff1d(np.arange(n), starts)
    rest = rest[np.argsort((rest * 2654435761) % 2**32, kind="stable")]  # a fixed shuffle
    batches, at, size = [starts], 0, 8
    while at < len(rest):
        batches.append(rest[at : at + size])
        at, size = at + size, min(2 * size, 256)
    for k, batch in enumerate(batches):
        own = np.repeat(np.arange(len(batch)), len(batch)), np.tile(batch, len(batch))
        if k:
            row, node = np.nonzero(_top(search(x, graph, starts, x[batch])))
            own = np.concatenate([own[0], row]), np.concatenate([own[1], node])
        graph[batch] = robust_prune(x, batch, _nearest_first(x, batch, *own))
        src, slot = np.nonzero(graph[batch] >= 0)
        to, back = graph[batch][src, slot], batch[src]
        targets, owner = np.unique(to, return_inverse=True)
        held, slot = np.nonzero(graph[targets] >= 0)
        pool = _nearest_first(x, targets, np.concatenate([owner, held]), np.concatenate([back, graph[targets][held, slot]]))
        few = (pool >= 0).sum(axis=1) <= DEGREE
        graph[targets[few]] = pool[few, :DEGREE]
        if (~few).any():
            graph[targets[~few]] = robust_prune(x, targets[~few], pool[~few])
    return graph, starts


def _top(seen: np.ndarray) -> np.ndarray:
    """The POOL best of each row that were seen."""
    if seen.shape[1] <= POOL:
        return seen > -np.inf
    least = np.partition(seen, -POOL, axis=1)[:, -POOL]
    return (seen >= least[:, None]) & (seen > -np.inf)


def _vectors(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _builder():
    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("rep")
        reps = table["rep"].to_numpy()
        graph, starts = build(unit(_vectors(table["v"])))
        # pruning may have cut all edges to a node: its nearest neighbour always leads back
        back = np.flatnonzero(graph[:, 0] >= 0)
        src, slot = np.nonzero(graph >= 0)
        edge = np.unique(np.concatenate([src * len(reps) + graph[src, slot], graph[back, 0] * len(reps) + back]))
        ends = np.searchsorted(edge, np.arange(len(reps) + 1) * len(reps))
        start = np.zeros(len(reps), bool)
        start[starts] = True
        return pa.table({
            "length": pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), len(reps)), "cluster": pa.repeat(pa.scalar(key[1].as_py(), pa.int32()), len(reps)),
            "rep": reps, "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(reps[edge % len(reps)])), "start": start})

    return run


def _finder(threshold: float):
    def run(key, queries, nodes):
        import pyarrow as pa

        schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("n", pa.int64())])
        if not len(queries) or not len(nodes):
            return schema.empty_table()
        nodes = nodes.sort_by("rep")
        ids, size = nodes["rep"].to_numpy(), nodes["size"].to_numpy()
        homes, x = _vectors(nodes["homes"]), unit(_vectors(nodes["v"]))
        near = nodes["near"].combine_chunks()
        owner, other = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy()), near.flatten().to_numpy()
        place = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        here = ids[place] == other
        owner, place = np.divmod(np.unique(owner[here] * len(ids) + place[here]), len(ids))
        slot = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(ids)))[owner]
        graph = np.full((len(ids), max(1, slot.max(initial=0) + 1)), -1)
        graph[owner, slot] = place
        starts = np.flatnonzero(nodes["start"].to_numpy(zero_copy_only=False))
        asked, q = queries["rep"].to_numpy(), unit(_vectors(queries["v"]))
        probes, turn = _vectors(queries["probes"]), queries["turn"].to_numpy()
        found, own, other = [], [], []
        for s in range(0, len(q), _CHUNK):
            row, node = np.nonzero(search(x, graph, starts, q[s : s + _CHUNK], threshold - REACH) >= threshold)
            row += s
            row, node = row[asked[row] != ids[node]], node[asked[row] != ids[node]]
            own.append(row)
            other.append(node)
            # a pair counts where the query first meets a cluster that the node is in
            before = np.arange(probes.shape[1]) < turn[row][:, None]
            met = (before[:, :, None] & (probes[row][:, :, None] == homes[node][:, None, :])).any(axis=(1, 2))
            found.append(np.bincount(row[~met], weights=size[node[~met]], minlength=len(q)))
        own, other, n = np.concatenate(own), np.concatenate(other), np.sum(found, axis=0).astype(np.int64)
        # components of the pairs of this task: one row for each of its vectors, not each pair
        every, place = np.unique(np.concatenate([asked[own], ids[other]]), return_inverse=True)
        a, b = place[: len(own)], place[len(own) :]
        label = np.arange(len(every))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        counts = pa.table({"rep": asked, "label": asked, "n": n}, schema=schema)
        return pa.concat_tables([counts.filter(pa.array(n > 0)), pa.table({"rep": every, "label": every[label], "n": np.zeros(len(every), np.int64)}, schema=schema)])

    return run


def _placer(books: np.ndarray, probes: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            v = b.column(2)
            lengths = v.value_lengths().to_numpy()
            near = np.zeros((len(b), probes), np.int32)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                width = min(length, books.shape[1])
                for s in range(0, len(at), 1024):
                    score = x[s : s + 1024, :width] @ books[:, :width].T
                    near[at[s : s + 1024]] = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probes), pa.int32()), pa.array(near.ravel()))], names=["rep", "size", "v", "probes"])

    return run


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows."""
    books = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        at = np.concatenate([np.argmax(sample[s : s + 1024] @ books.T, axis=1) for s in range(0, len(sample), 1024)])
        sums = np.zeros_like(books)
        np.add.at(sums, at, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        books = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), books)
    return books


def _auditor(x: list[list[float]], ids: np.ndarray, threshold: float):
    def run(batches):
        import pyarrow as pa

        audited = [(i, unit(np.array([v]))[0]) for i, v in zip(ids.tolist(), x)]
        total = dict.fromkeys(ids.tolist(), 0)
        by_length: dict[int, list] = {}
        for i, v in audited:
            by_length.setdefault(len(v), []).append((i, v))
        for b in batches:
            v, reps, size = b.column(2), b.column(0).to_numpy(), b.column(1).to_numpy()
            lengths = v.value_lengths().to_numpy()
            for length, rows in by_length.items():
                at = np.flatnonzero(lengths == length)
                if len(at):
                    y = unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                    linked = np.stack([r[1] for r in rows]) @ y.T >= threshold
                    for (i, _), hit in zip(rows, linked):
                        total[i] += int(size[at[hit & (reps[at] != i)]].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["rep", "n"])

    return run


def _one_row_per_vector(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame | None]:
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(f"`{vector_col}`").alias("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("d")).first()
    if n["n"] == n["d"]:
        return rows, None
    rows = rows.groupBy("_id", "v").agg(F.xxhash64("v").alias("_h")).withColumnRenamed("_id", "_outer")
    rows = number_rows(rows, ["_outer", "_h"], "_id")
    return rows.select("_id", "v"), rows.select("_id", "_outer")


def _searched(spark: SparkSession, classes: DataFrame, books: np.ndarray, probes: int, threshold: float, kind: str) -> DataFrame:
    """``rep, label, n``: what the searches of all tasks found, a row for a vector and task."""
    placed = stored(classes.mapInArrow(_placer(books, probes), f"rep long, size long, v {kind}, probes array<int>"), "placed")
    placed = placed.withColumn("length", F.size("v")).withColumn("homes", F.slice("probes", 1, MEMBERS))
    members = placed.select("*", F.explode("homes").alias("cluster"))
    asked = placed.select("rep", "v", "probes", "length", F.posexplode("probes").alias("turn", "cluster"))
    sizes = members.groupBy("length", "cluster").agg(F.count("*").alias("members"))
    sizes = sizes.join(asked.groupBy("length", "cluster").agg(F.count("*").alias("queries")), ["length", "cluster"])
    sizes = stored(sizes.select("length", "cluster", "members", "queries", F.ceil(F.col("members") / NODES).alias("graphs"), F.ceil(F.col("queries") / QUERIES).alias("turns")), "clusters")
    n_members, n_asked = sizes.agg(F.sum("members"), F.sum("queries")).first()
    key = ["length", "cluster"]
    members = salted_join(members, sizes, key, "members", n_members).withColumn("graph", F.pmod(F.xxhash64("rep"), F.col("graphs")))
    members = stored(members.select("length", "cluster", "graph", "turns", "rep", "size", "v", "homes"), "members")
    edges = stored(members.groupBy("length", "cluster", "graph").applyInArrow(_builder(), "length int, cluster int, rep long, near array<long>, start boolean"), "edges")
    union = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # of MEMBERS graphs
    nodes = members.join(union, "rep").join(edges.select("length", "cluster", "rep", "start"), ["length", "cluster", "rep"])
    nodes = nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    queries = salted_join(asked, sizes, key, "queries", n_asked)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("turns"))).withColumn("graph", F.explode(F.sequence(F.lit(0).cast("long"), F.col("graphs") - 1)))
    task = ["length", "cluster", "graph", "block"]
    queries = queries.select(*task, "rep", "v", "probes", "turn")
    nodes = nodes.select(*task, "rep", "size", "v", "homes", "near", "start")
    return stored(queries.groupBy(*task).cogroup(nodes.groupBy(*task)).applyInArrow(_finder(threshold), "rep long, label long, n long"), "found")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, least_recall: float = LEAST_RECALL,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: links of vectors with a cosine of ``threshold`` or more.

    Equal vectors are one class from the start.  Centroids of a bounded sample (SAMPLE) deal
    every class to its MEMBERS nearest clusters, so clusters overlap; a cluster of over NODES
    members has several graphs.  A graph is built in each by greedy search and robust pruning,
    and a node's lists of all its graphs are united.  Every class is then searched for, from the
    medoids of each graph of its ``probes`` nearest clusters: greedily, then expanding all that
    is within reach.  What is found is verified by its cosine in double precision.

    The recall is audited: AUDIT classes, chosen by hash, are compared with all others.  While less than
    ``least_recall`` of their links were found, the number of clusters searched is doubled, up to all.

    A task has one graph and a block of its queries, and returns a row for each of its vectors,
    not for each pair.  Vectors that are null, empty, zero or hold a null, infinite or undefined component,
    and those of different lengths, are not linked.  Rows equal in id (null is an id) and vector
    are one, others that repeat an id are vectors of their own; an empty table gives an empty result;
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows, ids = _one_row_per_vector(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["v"]
    sound = valid(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.select("_id", F.when(sound, F.col("v")).alias("v")).withColumn("digest", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.to_json(F.struct("v")), 256)))), "vectors")
    classes = stored(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")), "classes")
    n, total, longest = classes.agg(F.count("*"), F.sum("size"), F.max(F.size("v"))).first()
    alone = rows.where(F.col("digest").isNull()).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("label"))
    if n:
        by_hash = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep")
        sample = [r["v"] for r in by_hash.limit(max(1, min(SAMPLE, SAMPLE_VALUES // longest))).collect()]
        padded = np.zeros((len(sample), longest))
        for i, v in enumerate(sample):
            padded[i, : len(v)] = v
        k = int(max(1, min(-(-n * MEMBERS // CLUSTER), MAX_CLUSTERS, len(sample) // 4)))
        books = centroids(unit(padded), k)
        audited = by_hash.limit(max(1, min(AUDIT, SAMPLE_VALUES // longest))).collect()
        reps = np.array([r["rep"] for r in audited], np.int64)
        plain = classes.select("rep", "size", "v")
        counts = plain.mapInArrow(_auditor([list(r["v"]) for r in audited], reps, threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
        true = {r["rep"]: r["n"] for r in counts.collect()}  # AUDIT rows
        probes = min(probes, k)
        while True:
            found = _searched(spark, plain, books, probes, threshold, kind)
            n_found = found.groupBy("rep").agg(F.sum("n").alias("n"))
            got = {r["rep"]: r["n"] for r in n_found.where(F.col("rep").isin(reps.tolist())).collect()}
            if probes == k or sum(got.values()) >= least_recall * sum(true.values()):
                break
            probes = min(2 * probes, k)
        labels = components(found.where("label <> rep").select(F.col("rep").alias("a"), F.col("label").alias("b")))
        joined = classes.select("digest", "size", "rep").join(n_found, "rep", "left").join(labels, "rep", "left")
        joined = joined.select("digest", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "rep").alias("label"))
        of_rows = rows.where(F.col("digest").isNotNull()).select("_id", "digest")
        alone = salted_join(of_rows, joined, ["digest"], "size", total).select("_id", "n_links", "label").unionByName(alone)
    if ids is None:
        out = alone.withColumn("component_id", outer_id("label"))
    else:
        out = stored(alone, "components")
        sizes = with_ids(out.groupBy("label").agg(F.count("*").alias("size")), ids, "label", "component_id")
        out = salted_join(out, sizes, ["label"], "size", out.count())
    return with_ids(out, ids).select(F.col("doc_id").alias("vec_id"), "n_links", "component_id", (F.col("_id") == F.col("label")).alias("kept"))
