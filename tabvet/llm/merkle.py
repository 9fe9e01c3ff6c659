"""Merkle manifest of a table: a tree of copied SHA-256 states."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rownum import number_rows
from .common import salted_join, stored

#: Children of a parent.
RUN = 8
#: Levels that one group of rows holds: a block has RUN ** LEVELS nodes at its foot.
LEVELS = 3
BLOCK = RUN**LEVELS

_PATH = "array<struct<slot:int,run:array<binary>>>"


class Parent:
    """A node with the hash states that it had before each of its children.

    ``hashlib`` copies such a state; the digest after another child in one slot is
    that slot's state, resumed with the child and the siblings on its right.
    """

    def __init__(self, children: list[bytes]):
        state, self.states, self.children = hashlib.sha256(), [], children
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self.right = [b"".join(children[s + 1 :]) for s in range(len(children))]

    def fold(self, slot: int, child: bytes) -> bytes:
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.right[slot])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot]) + self.right[slot]


@dataclass
class Manifest:
    """``leaves(tree, pos, n, id, leaf, changed)``, one a row, with digests as bytes;
    ``blocks``, a table a round of (tree, block, n, l0, l1, l2): the digests of a block's
    levels from its foot, ``n`` nodes the tree has at that foot; ``tops``, the same of the
    tree over the subroots; ``subroots(tree, rank, digest)``; ``root``, lowercase hex."""

    leaves: DataFrame
    blocks: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame
    root: str | None


def encoded(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def _raised(level: Column) -> Column:
    """The parents of a level of digests."""
    runs = F.sequence(F.lit(0), ((F.size(level) - 1) / RUN).cast("int"))
    joined = lambda j: F.array_join(F.transform(F.slice(level, j * RUN + 1, RUN), lambda x: F.lower(F.hex(x))), "")
    return F.transform(runs, lambda j: F.unhex(F.sha2(joined(j), 256)))


def _rounds(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Tables of blocks over ``nodes(tree, pos, n, digest)``, until each tree has one block.

    ``most`` is the largest ``n``.  A node above the foot is made only while more than one
    node is left in the whole tree; so a tree of one node is that node.
    """
    tables = []
    while True:
        feet = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("feet"))
        blocks = feet.select("tree", "block", "n", F.col("feet.digest").alias("l0"))  # BLOCK nodes at most
        for k in range(1, LEVELS + 1):
            blocks = blocks.withColumn(f"l{k}", F.when(F.col("n") > RUN ** (k - 1), _raised(F.col(f"l{k - 1}"))))
        top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
        blocks = stored(blocks.select("tree", "block", "n", *[f"l{k}" for k in range(LEVELS)], F.get(top, 0).alias("digest")), name)
        tables.append(blocks)
        if most <= BLOCK:
            return tables
        most = -(-most // BLOCK)
        nodes = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest")


def _paths_of_feet(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, pos, path`` of each node at the foot of ``blocks``: for each level the slot and
    the run that the node's ancestor stands in, then ``above(tree, block, path)``."""
    i = F.col("i")
    steps = []
    for k in range(LEVELS):
        at = F.floor(i / RUN**k).cast("int")
        run = F.slice(f"l{k}", F.floor(i / RUN ** (k + 1)).cast("int") * RUN + 1, RUN)
        step = F.array(F.struct((at % RUN).alias("slot"), run.alias("run")))
        steps.append(F.when(F.col("n") > RUN**k, step.cast(_PATH)).otherwise(F.array().cast(_PATH)))
    feet = blocks.select("*", F.explode(F.sequence(F.lit(0), F.size("l0") - 1)).alias("i"))
    feet = feet.select("tree", "block", (F.col("block") * BLOCK + i).alias("pos"), F.concat(*steps).alias("path"))
    return feet.join(above, ["tree", "block"]).select("tree", "pos", F.concat(feet["path"], above["path"]).alias("path"))


def _paths_of_blocks(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, block, path`` of the blocks of the first round, given those of the last."""
    for blocks in reversed(tables[1:]):
        above = _paths_of_feet(blocks, above).withColumnRenamed("pos", "block")
    return above


def manifest(rows: DataFrame, columns: list[str], group: str, key: str, changed: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``rows``: leaves over ``columns``, a tree for each value of ``group`` with
    its leaves in the order of ``key``, and a tree over the subroots.

    ``changed`` names columns with other values; each leaf also gets the digest that it has
    with those (null where nothing differs).  Every row is a leaf, equal rows too; a null key
    comes first and rows with one key are in the order of their digests.  A null ``group`` is a
    tree of its own and the first.  Without rows there are no leaves and no root.  Other columns
    are not read.

    Leaves are numbered by one range shuffle and dealt to groups of BLOCK, so neither a large
    tree nor many rows of one key meet in a task.
    """
    spark = rows.sparkSession

    def leaf(values: dict[str, Column]) -> Column:
        return F.unhex(F.sha2(F.concat(*[encoded(values.get(c, F.col(f"`{c}`"))) for c in columns]), 256))

    tree = F.when(F.col(f"`{group}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    other = leaf(changed or {})
    leaves = rows.select(tree.alias("tree"), F.col(f"`{key}`").cast("long").alias("id"), leaf({}).alias("leaf"), other.alias("changed"))
    leaves = leaves.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    numbered = number_rows(leaves, ["tree", "id", "leaf"], "nr")
    trees = stored(numbered.groupBy("tree").agg(F.count("*").alias("n"), F.min("nr").alias("first")), "trees")
    total, most = trees.agg(F.sum("n"), F.max("n")).first()
    placed = salted_join(numbered, trees, ["tree"], "n", total or 0)
    placed = stored(placed.select("tree", (F.col("nr") - F.col("first")).alias("pos"), "n", "id", "leaf", "changed"), "leaves")
    blocks = _rounds(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")), most or 0, "blocks")
    ranked = number_rows(blocks[-1].select("tree", "digest"), ["tree"], "rank")
    subroots = stored(ranked.select("tree", (F.col("rank") - 1).alias("rank"), "digest"), "subroots")
    n_trees = subroots.count()
    nodes = subroots.select(F.lit("").alias("tree"), F.col("rank").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest")
    tops = _rounds(nodes, n_trees, "tops")
    root = tops[-1].first()
    return Manifest(placed, blocks, tops, subroots, root["digest"].hex() if root else None)


def _folder(root: str):
    def fold(key, leaves, above):
        import pyarrow as pa

        order = leaves.sort_by("pos").select(["id", "leaf", "changed"]).to_pydict()
        own = above.to_pylist()[0]
        level, parents = [x.hex().encode() for x in order["leaf"]], []
        for k in range(LEVELS):
            if own["n"] > RUN**k:
                parents.append([Parent(level[s : s + RUN]) for s in range(0, len(level), RUN)])
                level = [p.digest for p in parents[-1]]
        upper = [(Parent([x.hex().encode() for x in step["run"]]), step["slot"]) for step in own["path"]]
        upper_siblings = b"".join(p.siblings(slot) for p, slot in upper)
        out: dict[str, list] = {"id": order["id"], "leaf": [], "subroot": [], "root": [], "proof_sha256": [], "folded_root": [], "verified": []}
        for i, (leaf, changed) in enumerate(zip(order["leaf"], order["changed"])):
            digest, proof = (leaf if changed is None else changed).hex().encode(), hashlib.sha256()
            for k, row in enumerate(parents):
                parent, slot = row[i // RUN ** (k + 1)], i // RUN**k % RUN
                digest = parent.fold(slot, digest)
                proof.update(parent.siblings(slot))
            for parent, slot in upper:
                digest = parent.fold(slot, digest)
            proof.update(upper_siblings)
            out["leaf"].append(leaf.hex())
            out["subroot"].append(own["subroot"].hex())
            out["root"].append(root)
            out["proof_sha256"].append(proof.hexdigest())
            out["folded_root"].append(digest.decode())
            out["verified"].append(digest.decode() == root)
        return pa.table(out, schema=pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in list(out)[1:-1]], ("verified", pa.bool_())]))

    return fold


def verify(m: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

    Each leaf (its changed digest where it has one) is folded up to the root: a parent
    resumes the state that it retains before the leaf's slot, with the siblings on the right
    only.  ``proof_sha256`` is over all siblings of all levels, from the leaf's up.
    A task has a block of leaves and the path from that block to the root.
    """
    spark = m.leaves.sparkSession
    empty = F.array().cast(_PATH).alias("path")
    top = _paths_of_blocks(m.tops, m.tops[-1].select("tree", "block", empty))
    of_tree = _paths_of_feet(m.tops[0], top).select(F.col("pos").alias("rank"), "path")
    last = m.subroots.join(of_tree, "rank").select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    above = stored(_paths_of_blocks(m.blocks, last.select("tree", "block", "path")), "paths")
    sizes = m.blocks[0].select("tree", "block", "n")
    trees = m.subroots.select("tree", F.col("digest").alias("subroot"))
    n_blocks = sizes.groupBy("tree").agg(F.count("*").alias("members"))
    above = salted_join(above, trees.join(n_blocks, "tree"), ["tree"], "members", sizes.count()).drop("members").join(sizes, ["tree", "block"])
    leaves = m.leaves.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "id", "leaf", "changed")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if m.root is None:
        return spark.createDataFrame([], schema)
    return leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_folder(m.root), schema)
