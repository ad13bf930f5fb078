"""Connected components by alternating large-star and small-star steps over locally contracted edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

#: Edges that a task contracts at once.
CHUNK = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect the same nodes as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        up, down = root[x], root[y]
        apart = up != down
        if not apart.any():
            break
        x, y, up, down = x[apart], y[apart], up[apart], down[apart]
        np.minimum.at(root, np.maximum(up, down), np.minimum(up, down))
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each run of ``CHUNK`` edges of a partition becomes stars around its least nodes."""

    def star(held):
        both = [np.concatenate([batch.column(k).to_numpy(zero_copy_only=False) for batch in held]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(*both)], ["a", "b"])

    def contract(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    # One join gives both kinds of links, so the large star's result has two readers, alike.
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).filter("a != b").distinct()


def _has_chains(stars: DataFrame) -> bool:
    """Whether a node has two links down, or a link down and a node that links to it."""
    ends = stars.select(F.col("a").alias("x"), F.lit(1).alias("down")).unionByName(stars.select(F.col("b").alias("x"), F.lit(0).alias("down")))
    return not ends.groupBy("x").agg(F.sum("down").alias("downs"), F.min("down").alias("least")).filter("downs > 1 or downs = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the least node reachable.

    Partitions of edges are contracted by themselves first and in each round, which leaves few rounds.
    Each round writes its edges to the shared folder, so no lineage builds up and a
    lost executor costs one round. Ends when all edges are stars around least nodes. Self-loops
    are ignored, repeated edges count once; no edges give no rows.
    """
    now = written(_contracted(edges.filter("a != b")).distinct(), "edges")
    while _has_chains(now):
        nxt = written(_small_star(_large_star(_contracted(now))), "edges")
        drop_written(now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
