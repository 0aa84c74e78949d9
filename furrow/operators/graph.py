"""Connected components of an edge table: alternating star contractions, and contraction to parents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import materialise

MAX_ROUNDS = 60
#: Edges that a task contracts at once.
EDGES = 1 << 20
#: Rounds of hanging_nodes() before the rest goes to star contractions.
CONTRACTIONS = 8


def _toward_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step on edges (a > b): hang neighbours on the least one around each node.

    both_ways: larger neighbours of a node move to its least neighbour; else the node
    itself and its smaller neighbours do.
    """
    if both_ways:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = around.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, and no node that hangs has others hanging on it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not sums.agg(F.bool_or((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Nodes are of any type with an order. Each round writes its edges to the shared
    folder, so lineage stays short and a lost executor costs one round at most; only one
    boolean a round comes to the driver. Rounds grow with the logarithm of the longest
    path. Null ends and loops are dropped; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(now):
            break
        now = materialise(_toward_least(_toward_least(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these edges connect it with) of all nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _parents(edges: DataFrame) -> DataFrame:
    """(node, parent) of the forests that tasks make of their edges, and (node, null) once a task for every parent."""

    def rows(a, b):
        node, parent = local_forest(a, b)
        used = np.unique(parent)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, used))), pa.concat_arrays([pa.array(parent), pa.nulls(len(used), pa.int64())])], names=["node", "parent"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= EDGES:
                yield rows(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
                held = []
        if held:
            yield rows(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))

    return edges.mapInArrow(run, "node long, parent long")


def hanging_nodes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge but the least of each component, which names it.

    Nodes are of type long. Each round is one shuffle: tasks contract their edges, and a
    node meets its parents, at most one for each EDGES of a task however many edges it
    has. A node that nothing hangs on is final below the least of them; the others, and
    the parents that a node connects, are the next round's edges. Long paths whose numbers
    rise along them lose few nodes a round, so what is left after CONTRACTIONS rounds goes
    to connected_components(). Rounds are written to the shared folder and one boolean of
    each comes to the driver; from the last round on, parents are replaced by their
    components. Null ends and loops are dropped; a graph without edges gives no rows.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    levels = []
    for _ in range(CONTRACTIONS):
        met = _parents(left).groupBy("node").agg(F.min("parent").alias("parent"), F.bool_or(F.col("parent").isNull()).alias("used"), F.collect_set("parent").alias("all")).filter("parent IS NOT NULL")
        own = F.struct("node", "parent", F.col("used").alias("open"))
        others = F.transform(F.array_remove("all", F.col("parent")), lambda x: F.struct(x.alias("node"), F.col("parent").alias("parent"), F.lit(True).alias("open")))
        level = materialise(met.select(F.inline(F.concat(F.array(own), others))), "parents")
        levels.append(level.filter("NOT open").select("node", "parent"))
        left = level.filter("open").select("node", "parent")
        if not level.agg(F.bool_or("open")).first()[0]:
            break
    else:
        levels.append(connected_components(left, "node", "parent").filter("node <> component").withColumnRenamed("component", "parent"))
    found = levels.pop().withColumnRenamed("parent", "component")
    for level in reversed(levels):
        above = found.select(F.col("node").alias("parent"), "component")
        found = level.join(above, "parent", "left").select("node", F.coalesce("component", "parent").alias("component")).union(found)
    return found
