"""Connected components by alternating large-star and small-star steps; what fits one task is joined there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.common import cut

#: So many edges (16 bytes each) or fewer are taken to one task.
EDGES_IN_A_TASK = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and for each the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(np.stack([at[: len(a)], at[len(a) :]], axis=1), axis=0)
    up = list(range(len(nodes)))
    for x, y in pairs.tolist():
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array(up, dtype=np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    return nodes, nodes[root]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node points its larger neighbours, then itself and its smaller ones, at the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hang = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hang.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(batches):
    """All edges' nodes and roots, by union and find."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its least node. Null ends and loops are left out."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct())
    state = _state(now)
    while state[0] > EDGES_IN_A_TASK:
        now = cut(_stars(now))
        then, state = state, _state(now)
        if then == state:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))).distinct()
    return now.coalesce(1).mapInArrow(_joined, "node long, component long")
