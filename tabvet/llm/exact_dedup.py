"""Exact duplicates by Patricia tries over full byte strings."""

from __future__ import annotations

import hashlib
import struct
import tempfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_per_text, partitions, salted_join, sliced, stored, with_ids

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
COMBINE_BYTES = 24_000_000
TRIE_BYTES = 96_000_000
#: Combined texts go on in batches of so many bytes.
FLUSH_BYTES = 1_000_000

#: Of equal texts the one with the most code points, then the smallest id; and their number.
Best = tuple[int, int, int]


def better(a: Best, b: Best) -> Best:
    best = a if (-a[0], a[1]) <= (-b[0], b[1]) else b
    return best[0], best[1], a[2] + b[2]


class Node:
    __slots__ = ("children", "label", "file", "value")

    def __init__(self, label: bytes, value: Best | None = None) -> None:
        self.label, self.value = label, value
        self.children: dict[int, Node] = {}
        self.file = None  # of a subtree that was spilled


class Trie:
    """Compressed radix trie: byte strings to ``Best``.

    Over ``limit`` bytes of labels, the largest subtree below the first branching
    goes to a file of the task's own; later strings of that subtree are added to
    the file.  ``items`` reads each such file into a trie of its own at the end.
    """

    NODE = 200  # about what a node takes besides its label

    def __init__(self, limit: int = TRIE_BYTES) -> None:
        self.limit, self.bytes, self.root = limit, 0, Node(b"")

    def insert(self, key: bytes, value: Best) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                self._record(node.file, key[at:], value)
                return
            if at == len(key):
                node.value = value if node.value is None else better(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.bytes += len(key) - at + self.NODE
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            low, high = 1, min(len(rest), len(label))  # the first byte is shared
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if rest[:mid] == label[:mid] else (low, mid - 1)
            fork = Node(label[:low])
            child.label = label[low:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            self.bytes += self.NODE
            node, at = fork, at + low
        if self.bytes > self.limit:
            self._spill()

    @staticmethod
    def _record(file, key: bytes, value: Best) -> None:
        file.write(struct.pack("<Iqqq", len(key), *value) + key)

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(prefix, node)]
        while stack:
            path, x = stack.pop()
            yield path, x
            stack += [(path + c.label, c) for c in x.children.values()]

    def _spill(self) -> None:
        node = self.root
        while node.value is None and len(node.children) == 1 and node.file is None:
            (node,) = node.children.values()
        held = {k: sum(len(x.label) + self.NODE for _, x in self._walk(c, b"")) for k, c in node.children.items() if c.file is None}
        if not held:
            return
        child = node.children[max(held, key=held.get)]
        file = tempfile.TemporaryFile()
        for path, x in self._walk(child, b""):
            if x.file is not None:
                for key, value in self._read(x.file):
                    self._record(file, path + key, value)
            elif x.value is not None:
                self._record(file, path, x.value)
        self.bytes -= max(held.values())
        child.children, child.value, child.file = {}, None, file

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, Best]]:
        file.seek(0)
        while head := file.read(28):
            n, *value = struct.unpack("<Iqqq", head)
            yield file.read(n), tuple(value)
        file.close()

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, Best]]:
        spilled = []
        for path, x in self._walk(self.root, prefix):
            if x.file is not None:
                spilled.append((path, x.file))
            elif x.value is not None:
                yield path, x.value
        self.root, self.bytes = Node(b""), 0
        for path, file in spilled:
            part = Trie(self.limit)
            for key, value in self._read(file):
                part.insert(key, value)
            yield from part.items(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, text_sha256``: the class of each document.

    Texts are equal when they are identical after ``WHITE`` is deleted.  Each map
    task first combines its own equal texts, so a text that a third of all rows
    share reaches its owner once a task; owners hold texts by length and content
    hash and insert the full bytes.  The class then joins back to the narrow rows,
    hot classes split by salt.

    Null text counts as empty, and empty texts are one class; rows equal in
    id (null is an id) and text are one document, others that repeat an id are documents
    of their own; ties go to the smallest id; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows, ids = one_row_per_text(docs, id_col, text_col)

    def combine(batches):
        import pyarrow as pa

        held: dict[bytes, Best] = {}
        size = 0

        def flush():
            while held:
                keys, values, size = [], [], 0
                while held and size < FLUSH_BYTES:
                    key, value = held.popitem()
                    keys.append(key)
                    values.append(value)
                    size += len(key) + 200
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(k) for k in keys], pa.int32()), pa.array([zlib.crc32(k) for k in keys], pa.int64()), pa.array(keys, pa.binary())]
                    + [pa.array([v[i] for v in values], pa.int64()) for i in range(3)],
                    names=["len", "hash", "body", "chars", "id", "n"],
                )

        for b in sliced(batches):
            for doc, chars, text in zip(*(c.to_pylist() for c in b.columns)):
                key, value = text.translate(None, WHITE), (chars, doc, 1)
                if (old := held.get(key)) is None:
                    held[key] = value
                    size += len(key) + 200
                    if size > COMBINE_BYTES:
                        yield from flush()
                        size = 0
                else:
                    held[key] = better(old, value)
        yield from flush()

    def own(batches):
        import pyarrow as pa

        trie = Trie()
        for b in sliced(batches, column=0):
            cols = [c.to_pylist() for c in b.columns]
            for key, *value in zip(*cols):
                trie.insert(key, tuple(value))
        out: list[tuple] = []

        def flush():
            digests, values = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.int64())],
                names=["digest", "keep", "group_size"],
            )

        for key, value in trie.items():
            out.append((hashlib.sha256(key).digest(), value))
            if len(out) == 10_000:
                yield from flush()
                out.clear()
        if out:
            yield from flush()

    def digests(batches):
        import pyarrow as pa

        for b in sliced(batches):
            found = [hashlib.sha256(t.translate(None, WHITE)).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["_id", "digest"])

    body = F.col("_text").cast("binary").alias("body")
    combined = rows.select("_id", F.char_length("_text").cast("long").alias("chars"), body).mapInArrow(
        combine, "len int, hash long, body binary, chars long, id long, n long"
    )
    owned = combined.repartition(partitions(spark), "len", "hash").select("body", "chars", "id", "n")
    groups = stored(owned.mapInArrow(own, "digest binary, keep long, group_size long"), "exact")
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    member = rows.select("_id", body).mapInArrow(digests, "_id long, digest binary")
    groups = with_ids(groups, ids, "keep", "keep_id")
    return with_ids(salted_join(member, groups, ["digest"], "group_size", n), ids).select(
        "doc_id", "keep_id", "group_size",
        (F.col("_id") == F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
