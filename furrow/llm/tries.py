"""Prefix trie of conversations: which first turns conversations share, and what sharing saves.

A turn gets a fixed-width big-endian id: 16 bytes of the SHA-256 of its role and text and
4 bytes of its length in code points. The chance that two of 10**12 different turns share
their 16 bytes is 2e-15. A conversation is the string of its turns' ids, 20 bytes a turn in
one row, whatever its texts weigh.

Conversations are dealt into ranges of (string, id), so equal conversations spread over as
many tasks as they need, and sorted. Each megabyte of strings, a chunk, becomes an adaptive
radix tree, and its turn-aligned depths become nodes with sums over their subtrees. As
chunks follow one another in order, a node lies in several chunks only on the path of a
chunk's first or last string. Those few are merged: what a chunk counted again is taken
off, and the rest is final without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.llm.radix import Tree
from furrow.llm.text import tidy
from furrow.session import materialise

DIGEST, WIDTH = 16, 20
#: Bytes of strings in one radix tree.
CHUNK_BYTES = 1 << 20
ROOT = bytes(16)
_NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("depth", T.LongType()),
        T.StructField("chars", T.LongType()),
        T.StructField("path_chars", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("all_chars", T.LongType()),
        T.StructField("own_chars", T.LongType()),
        T.StructField("on_first", T.BooleanType()),
        T.StructField("on_last", T.BooleanType()),
        T.StructField("below_edge", T.BooleanType()),
        T.StructField("ends_sha256", T.StringType()),
        T.StructField("ends", T.BinaryType()),
    ]
)


def turn_strings(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id long, turns array<string>): the ids of each conversation's turns in order, in hexadecimal.

    Ordered by turn, null first; turns of equal number by their ids. Null role or text
    counts as empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        conversations[id_col].cast("long").alias("conv_id"),
        conversations[turn_col].alias("turn"),
        F.concat(
            F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST),
            F.lpad(F.lower(F.hex(F.length(text))), 2 * (WIDTH - DIGEST), "0"),
        ).alias("id"),
    ).filter("conv_id is not null")
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("turns"))


def rebuilt(strings: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with the first h turns of conversation c - c % every, h = crc32(c) % most."""
    heads = strings.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = strings.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    none = F.array().cast("array<string>")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _joined(ids: list[int]) -> bytes:
    return b",".join(b"%d" % i for i in ids)


class Chunk:
    """Nodes of one radix tree, parents before children and in the order of their strings."""

    def __init__(self, keys: list[bytes], ids: list[int]):
        tree = Tree()
        for key, i in zip(keys, ids, strict=True):
            tree.insert(key, i)
        self.nodes, self.above, self.chars, self.path, self.depth = bytearray(ROOT), [-1], [0], [0], [0]
        self.conv: list[int] = [0]
        self.convs, self.kids, self.leaves, self.all, self.own, self.sha, self.ends = ([0], [0], [0], [0], [0], [""], [None])
        self._fill(tree)
        last = len(keys[-1]) // WIDTH
        at = len(self.above) - 1
        while self.depth[at] > last:
            at = self.above[at]
        self.last, path = at, set()
        while at >= 0:
            path.add(at)
            at = self.above[at]
        self.on_first = np.arange(len(self.above)) <= len(keys[0]) // WIDTH
        self.on_last = np.zeros(len(self.above), bool)
        self.on_last[sorted(path)] = True
        self.first = len(keys[0]) // WIDTH

    def _enter(self, part: bytes, up: int) -> tuple[range, bytes]:
        """Number the turns that end inside `part`; (their numbers, bytes of a turn that goes on below)."""
        n = len(part) // WIDTH
        start, key = len(self.above), bytes(self.nodes[up * 16 : up * 16 + 16])
        for k in range(n):
            turn = part[k * WIDTH : (k + 1) * WIDTH]
            key = xxhash.xxh3_128_digest(key + turn)
            self.nodes += key
            size = int.from_bytes(turn[DIGEST:], "big")
            self.above.append(up)
            self.chars.append(size)
            self.path.append(self.path[up] + size)
            self.depth.append(self.depth[up] + 1)
            up = start + k
        for column in (self.conv, self.convs, self.kids, self.leaves, self.all, self.own):
            column += [0] * n
        self.sha += [""] * n
        self.ends += [None] * n
        return range(start, start + n), part[n * WIDTH :]

    def _leave(self, turns: range, node, sums: list) -> list:
        """Sums of the children up through the turns of this edge: conversations, smallest, child turns, leaves, characters."""
        n, low, heads, leaves, every, own = sums
        if node.ends:
            n, low = n + len(node.ends), min(node.ends if low is None else [*node.ends, low])
        for k, at in enumerate(reversed(turns)):
            leaves = leaves or 1
            every, own = every + n * self.chars[at], own + self.chars[at]
            self.conv[at], self.convs[at], self.kids[at], self.leaves[at], self.all[at], self.own[at] = low, n, heads, leaves, every, own
            self.ends[at], heads = node.ends if k == 0 else None, 1
        return [n, low, heads, leaves, every, own]

    def _fill(self, tree: Tree) -> None:
        stack = [(tree.root, range(0, 1), 0, b"", tree.root.children(), [0, None, 0, 0, 0, 0])]
        while stack:
            node, turns, up, rest, children, sums = stack[-1]
            child = next(children, None)
            if child is not None:
                below, left = self._enter(rest + child.label, up)
                stack.append((child, below, below[-1] if below else up, left, child.children(), [0, None, 0, 0, 0, 0]))
                continue
            stack.pop()
            done = self._leave(turns, node, sums)
            if stack:
                into = stack[-1][5]
                into[1] = done[1] if into[1] is None else min(into[1], done[1])
                for k in (0, 2, 3, 4, 5):
                    into[k] += done[k]

    def columns(self, chunk: int) -> list:
        """Columns of _NODE. Ends of the first and the last string are given, as other chunks may have more of them."""
        n = len(self.above)
        nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(bytes(self.nodes))]).cast(pa.binary())
        above = np.array(self.above)
        parents = nodes.take(pa.array(above, mask=above < 0))
        conv = np.array(self.conv, np.int64)
        edge = self.on_first | self.on_last
        open_ends = {self.first, self.last}
        ends = [_joined(e) if e and i in open_ends else None for i, e in enumerate(self.ends)]
        sha = [hashlib.sha256(_joined(e)).hexdigest() if e and i not in open_ends else None for i, e in enumerate(self.ends)]
        return [
            np.full(n, chunk),
            nodes,
            parents,
            np.array(self.depth),
            np.array(self.chars),
            np.array(self.path),
            conv,
            pa.array(conv[above], mask=above < 0),
            np.array(self.convs),
            np.array(self.kids),
            np.array(self.leaves),
            np.array(self.all),
            np.array(self.own),
            self.on_first,
            self.on_last,
            edge[above],
            sha,
            ends,
        ]


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows: the nodes of one tree for each chunk_bytes of keys; one conversation at least."""
    schema = to_arrow_schema(_NODE)
    task, number = TaskContext.get().partitionId(), 0
    keys, ids, held = [], [], 0

    def close():
        columns = Chunk(keys, ids).columns((task << 32) + number)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for key, i in zip(batch.column("key").cast(pa.binary()).to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            keys.append(key)
            ids.append(i)
            held += len(key) + 8
            if held > chunk_bytes:
                yield close()
                number += 1
                keys, ids, held = [], [], 0
    if keys:
        yield close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, chunk, ends): one digest a node, whatever the number of its pieces, holding one piece at a time."""
    node, digest = None, None

    def row():
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for at, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if at != node:
                if digest:
                    yield row()
                node, digest = at, hashlib.sha256(piece)
            else:
                digest.update(b",")
                digest.update(piece)
    if digest:
        yield row()


def trie(strings: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix of the conversations' turns.

    strings: (conv_id, turns) with one row a conversation, as turn_strings() gives it. The
    root, depth 0, has all conversations. saved_tokens sums, over a node's subtree, what
    its conversations but one would repeat of its last turn, in code points. ends_sha256 is
    over the comma-joined ids, ascending, of conversations that end at the node. Without
    conversations there is no node, not even the root.
    """
    keys = materialise(strings.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key")), "turn-strings")
    nodes = materialise(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(tidy(lambda batches: _chunks(batches, chunk_bytes)), _NODE), "turn-nodes")

    # What lies on the path of a chunk's first or last string may lie in other chunks, too.
    edge = nodes.filter("on_first or on_last").drop("parent_conv_id", "below_edge")
    leaf = F.col("n_children") == 0
    met = edge.groupBy("node").agg(F.min("chunk").alias("owner"), F.bool_and(leaf).alias("leaf"))
    edge = edge.join(met, "node")
    again = F.col("on_first") & (F.col("chunk") > F.col("owner"))
    fixes = edge.groupBy("chunk").agg(
        F.max(F.when(again, F.struct("depth", "path_chars"))).alias("seen"),
        F.coalesce(F.bool_or(again & leaf), F.lit(False)).alias("leaf_again"),
        F.coalesce(F.bool_or(F.col("on_last") & leaf & (F.col("chunk") == F.col("owner")) & ~F.col("leaf")), F.lit(False)).alias("leaf_goes_on"),
    )
    fixed = edge.join(fixes, "chunk").withColumns(
        {
            "own_chars": F.col("own_chars") - F.when(F.col("on_first") & (F.col("depth") <= F.col("seen.depth")), F.col("seen.path_chars") - F.col("path_chars") + F.col("chars")).otherwise(0),
            "n_children": F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < F.col("seen.depth")), 1).otherwise(0),
            "n_leaves": F.col("n_leaves") - F.when(F.col("on_first") & F.col("leaf_again"), 1).otherwise(0) - F.when(F.col("on_last") & F.col("leaf_goes_on"), 1).otherwise(0),
        }
    )
    merged = materialise(
        fixed.groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.min("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.max("ends_sha256").alias("inner_ends"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")),
            (F.sum("all_chars") - F.sum("own_chars")).alias("saved_tokens"),
        ),
        "turn-edges",
    )
    pieces = edge.filter("ends is not null").select("node", "chunk", "ends").repartition("node").sortWithinPartitions("node", "chunk")
    digests = pieces.mapInArrow(tidy(_digests), "node binary, ends_sha256 string")
    smallest = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = merged.join(smallest, "parent", "left").join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "inner_ends"))

    # All others are whole in their chunk; below such a path the parent's smallest id comes from the merged rows, chunk by chunk.
    rest = nodes.filter("not (on_first or on_last)").withColumn("saved_tokens", F.col("all_chars") - F.col("own_chars"))
    known = edge.select("chunk", F.col("node").alias("parent")).join(smallest, "parent")
    hung = rest.filter("below_edge").drop("parent_conv_id").join(known, ["chunk", "parent"])
    every = top.select(columns).unionByName(hung.select(columns)).unionByName(rest.filter("not below_edge").select(columns))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
