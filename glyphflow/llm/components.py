"""Connected components of an edge table: few edges in one task, more by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join that AQE may split where a node has very many neighbours. Between
steps the edges are written to the shared folder; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, settled

#: Up to so many edges (16 bytes each) are joined in one task, as a dozen jobs cost more than they do.
AT_ONCE = 1 << 18


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(batches):
    """Nodes and roots of all edges. A root goes to the smallest one that an edge leads to, until no edge leads to another."""
    edges = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches if batch.num_rows]
    if not edges:
        return
    nodes, at = np.unique([np.concatenate(x) for x in zip(*edges, strict=True)], return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((above := root[root]) != root).any():
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root for every node of the edges (a long, b long); root is the smallest node that it reaches.

    Loops and repeated edges do no harm; rows with a null end are left out. No edges: no rows. rows is the number of the
    edges, for a caller that has settled them.
    """
    edges = edges.where("a <> b").select("a", "b")
    if rows is None:
        edges, rows = counted(edges)
    if rows <= AT_ONCE:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _checksum(edges)
    while before[0]:
        # Large star: every larger neighbour moves to the smallest of the neighbourhood, the node itself included.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
