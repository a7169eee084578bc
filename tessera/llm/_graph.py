"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._base import scoped, sized, written

#: Most edges that one task joins by itself (16 MB of numbers); more are joined by stars.
LOCAL_EDGES = 1_000_000


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (every node points at its tree's smallest) with the pairs ``a``, ``b`` joined."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of edges, in one task."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    below = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["node", "component"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m")), "stars")
    return both.filter(F.col("v") > F.col("u")).join(sized(least), F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = written(down.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "stars")
    moved = down.join(sized(least), F.col("u") == F.col("n")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


@scoped
def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of all nodes of edges ``a``, ``b`` but the smallest.

    Nodes that are their component's smallest, or have no edge, are left out.
    Nothing but a count and a checksum comes to the driver.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if edges.count() <= LOCAL_EDGES:
        return written(edges.coalesce(1).mapInArrow(_local, "node long, component long"), "components")
    state = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    now = written(_small(edges), "components")
    before = state(now)
    while before[0]:
        # a star's nodes point at its smallest: done when no node points at a node that points on
        now = written(_small(written(_large(now), "stars")), "components")
        after = state(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
