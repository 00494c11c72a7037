"""Connected components of an edge table, with joins and grouped minima.

Alternating large-star and small-star rounds turn each component into a star
around its smallest node. A round keeps or lowers the number of edges; each
one ends in a reliable checkpoint, so the plan doesn't grow and a lost
executor costs one round. Nothing but two sums per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklane.session import cut_lineage


class Forest:
    """Union-find over array positions; the root is the smallest member."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` points to the least of u and its
    neighbours. The grouped minimum is combined before it is shuffled; the
    join is on ``u`` with one row per key on the small side, so a hot node is
    split by the skew join."""
    pairs = _both(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return (pairs.where("v > u").join(least, "u")
            .where("v != m").select(F.col("v").alias("a"),
                                    F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Node u and its smaller neighbours point to the least of them."""
    pairs = edges.select(F.greatest("a", "b").alias("u"),
                         F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    down = (pairs.join(least, "u").where("v != m")
            .select(F.col("v").alias("a"), F.col("m").alias("b")))
    return down.unionByName(least.select(
        F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _local(batches):
    """Within a task, edges that close a circle are redundant."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    ab = pa.Table.from_batches(tables)
    a, b = (ab.column(c).to_numpy() for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist(), strict=True):
        forest.union(x, y)
    root = np.array([forest.find(i) for i in range(len(nodes))])
    moved = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(a, b)`` long node pairs -> ``(node, root)``: one row for each node
    that has an edge to another, with the smallest node of its component.

    Loops, repeated and reversed edges are harmless; rows with a null are
    ignored; no edges give no rows."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")
                         ).where("a != b")
    edges = cut_lineage(edges.mapInArrow(_local, "a long, b long"))
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"),
                                F.col("b").alias("root"))
        seen = tuple(now)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
