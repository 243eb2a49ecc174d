"""Analytics over parse graphs: nodes and edges, grouped by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What depth and fan-out are measured against, and how many hotspots a report has.
DEPTH_SCALE, FAN_OUT_SCALE, HOTSPOTS = 20, 20, 5


def with_depth(nodes: DataFrame, edges: DataFrame, roots: DataFrame, id_col: str = "doc_id", limit: int = 100) -> DataFrame:
    """Nodes reachable from roots (id, node_id) with their shortest distance, for graphs that came without it.

    One join a level; the frontier shrinks to nothing on its own, and a deeper graph than limit raises an error.
    """
    from glyphflow.sources import cut_lineage

    found = cut_lineage(roots.select(id_col, "node_id").distinct().withColumn("depth", F.lit(0)))
    frontier, level = found, 0
    links = edges.select(id_col, F.col("parent_id").alias("node_id"), "child_id")
    while True:
        level += 1
        onward = frontier.join(links, [id_col, "node_id"]).select(id_col, F.col("child_id").alias("node_id")).distinct()
        frontier = cut_lineage(onward.join(found, [id_col, "node_id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        if level > limit:
            raise ValueError(f"the graph is deeper than {limit}")
        found = found.unionByName(frontier)
    return nodes.drop("depth").join(found, [id_col, "node_id"])


def fan_out(edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, node_id, children: distinct children over all packed nodes, and packed: how many derivations."""
    return edges.groupBy(id_col, F.col("parent_id").alias("node_id")).agg(F.count_distinct("child_id").alias("children"), F.count_distinct("packed_id").alias("packed"))


def type_histogram(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return nodes.groupBy(id_col, "node_type").agg(F.count("*").alias("n"))


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = HOTSPOTS, id_col: str = "doc_id") -> DataFrame:
    """The k nodes of a document with the most children, ties to the earlier start, then the smaller id.

    Spark takes exploded nodes and edges for a fraction of what they are, so neither is left to be broadcast.
    """
    rows = fan_out(edges, id_col).join(nodes.select(id_col, "node_id", "node_type", "source_start").hint("merge"), [id_col, "node_id"])
    order = Window.partitionBy(id_col).orderBy(F.col("children").desc(), "source_start", "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_col, "rank", "node_id", "node_type", "source_start", "children")


def report(nodes: DataFrame, edges: DataFrame, sources: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document that has nodes: counts, depth, fan-out, ambiguity, coverage, densities, complexity.

    nodes carry depth; sources are (id, source_length in bytes). A source without bytes has coverage 0.
    """
    fans = fan_out(edges, id_col)
    by_node = nodes.select(id_col, "node_id", "depth", "source_length").join(fans, [id_col, "node_id"], "left")
    totals = by_node.groupBy(id_col).agg(
        F.count("*").alias("node_count"),
        F.max("depth").alias("max_depth"),
        F.avg("children").alias("average_fan_out"),
        F.coalesce(F.max("children"), F.lit(0)).alias("max_fan_out"),
        F.coalesce(F.sum("children"), F.lit(0)).alias("total_fan_out"),
        F.sum(F.when(F.col("packed") > 1, 1).otherwise(0)).alias("ambiguous_nodes"),
        F.sum(F.when(F.col("children").isNull(), F.col("source_length")).otherwise(0)).alias("leaf_bytes"),
    )
    counted = edges.groupBy(id_col).agg(F.count("*").alias("edge_count"))
    rows = totals.join(counted, id_col, "left").join(sources.select(id_col, F.col("source_length").alias("__n")), id_col)
    rows = rows.withColumn("edge_count", F.coalesce("edge_count", F.lit(0))).withColumn("average_fan_out", F.coalesce("average_fan_out", F.lit(0.0)))
    rows = rows.withColumn("ambiguity_rate", F.col("ambiguous_nodes") / F.col("node_count"))
    rows = rows.withColumn("source_coverage", F.when(F.col("__n") > 0, F.least(F.lit(1.0), F.col("leaf_bytes") / F.col("__n"))).otherwise(0.0))
    kb = F.col("__n") / 1024
    rows = rows.withColumn("nodes_per_kb", F.when(kb > 0, F.col("node_count") / kb).otherwise(0.0)).withColumn("edges_per_kb", F.when(kb > 0, F.col("edge_count") / kb).otherwise(0.0))
    share = F.when(F.col("total_fan_out") > 0, F.least(F.lit(1.0), F.col("max_fan_out") / F.col("total_fan_out"))).otherwise(0.0)
    parts = [F.least(F.lit(1.0), F.col("max_depth") / DEPTH_SCALE), F.least(F.lit(1.0), F.col("max_fan_out") / FAN_OUT_SCALE), F.col("ambiguity_rate"), share]
    rows = rows.withColumn("complexity", sum(parts[1:], parts[0]) / 4)
    return rows.select(id_col, "node_count", "edge_count", "max_depth", "average_fan_out", "max_fan_out", "ambiguity_rate", "source_coverage", "nodes_per_kb", "edges_per_kb", "complexity")


def memory_estimate(n_tokens, n_paths):
    """Bytes that a run of so many tokens and paths is taken to hold."""
    return 64 * n_tokens + 128 * n_paths
