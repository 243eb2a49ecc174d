"""Selection over nodes and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_text(nodes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds node_text: the source bytes of a node's span.

    Both sides grow with the documents, and Spark takes exploded nodes for a fraction of what they are: neither is broadcast.
    """
    source = docs.select(F.col(id_col), F.encode(F.col(text_col), "UTF-8").alias("__b"))
    span = F.substring(F.col("__b"), (F.col("source_start") + 1).cast("int"), F.col("source_length").cast("int"))
    return nodes.join(source.hint("merge"), id_col).withColumn("node_text", F.decode(span, "UTF-8")).drop("__b")


def by_regex(nodes: DataFrame, pattern: str) -> DataFrame:
    return nodes.where(F.col("node_text").rlike(pattern))


def by_rule(nodes: DataFrame, kind: str) -> DataFrame:
    """Rule names that hold the text, ignoring case."""
    return nodes.where(F.contains(F.lower("rule_name"), F.lit(kind.lower())))


def in_range(rows: DataFrame, start: int | Column, end: int | Column, start_col: str = "source_start", length_col: str = "source_length") -> DataFrame:
    """Spans that lie within [start, end)."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return rows.where((F.col(start_col) >= lo) & (F.col(start_col) + F.col(length_col) <= hi))


def intersecting(rows: DataFrame, start: int | Column, end: int | Column, start_col: str = "start_pos", length_col: str = "length") -> DataFrame:
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return rows.where((F.col(start_col) < hi) & (F.col(start_col) + F.col(length_col) > lo))


def at_offset(rows: DataFrame, points: DataFrame | None, id_col: str = "doc_id", offset_col: str = "offset", start_col: str = "source_start", length_col: str = "source_length", innermost: bool = True) -> DataFrame:
    """Spans that hold a point of their document (equi-join on the document, then the interval); the innermost only,
    ties to the later start, then to the smaller remaining columns. Rows that carry their document's point need no points."""
    joined = (rows if points is None else rows.join(points, id_col)).where((F.col(start_col) <= F.col(offset_col)) & (F.col(offset_col) < F.col(start_col) + F.col(length_col)))
    if not innermost:
        return joined
    others = [c for c in rows.columns if c not in (id_col, offset_col, start_col, length_col)]
    best = F.min(F.struct(F.col(length_col), (-F.col(start_col)).alias("__s"), *others)).alias("__b")
    out = joined.groupBy(id_col, offset_col).agg(best)
    return out.select(id_col, offset_col, (-F.col("__b.__s")).alias(start_col), F.col(f"__b.{length_col}").alias(length_col), *[F.col(f"__b.{c}").alias(c) for c in others])


def line_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), start (byte): one row for each line."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("__i", "__l"))
    before = Window.partitionBy(id_col).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(id_col, (F.col("__i") + 1).alias("line"), F.coalesce(F.sum(F.octet_length("__l") + 1).over(before), F.lit(0)).cast("int").alias("start"))


def to_offset(starts: DataFrame, places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """places (id, line, column) with their byte offset; a line that isn't there has none."""
    return places.join(starts, [id_col, "line"], "left").withColumn("offset", F.col("start") + F.col("column") - 1).drop("start")


def line_of(starts: DataFrame, points: DataFrame, id_col: str = "doc_id", offset_col: str = "offset") -> DataFrame:
    """points (id, offset) with line and column: the last line start at or below (an as-of join in one sorted pass)."""
    both = starts.select(id_col, F.col("start").alias("__at"), "line", F.lit(0).alias("__k"), F.lit(None).cast("int").alias(offset_col)).unionByName(points.select(id_col, F.col(offset_col).alias("__at"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("__k"), F.col(offset_col).cast("int").alias(offset_col)))
    last = Window.partitionBy(id_col).orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("line", F.last("line", True).over(last)).withColumn("__s", F.last(F.when(F.col("__k") == 0, F.col("__at")), True).over(last))
    return told.where(F.col("__k") == 1).select(id_col, offset_col, "line", (F.col(offset_col) - F.col("__s") + 1).alias("column"))


def lookahead(tokens: DataFrame, n: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Adds next_type and next_value: the token n places on."""
    w = Window.partitionBy(id_col).orderBy("seq")
    return tokens.withColumn("next_type", F.lead("type", n).over(w)).withColumn("next_value", F.lead("value", n).over(w))


def sequences(tokens: DataFrame, types: list[str], id_col: str = "doc_id") -> DataFrame:
    """Where the token types follow one another: id, seq of the first, and their values (a projection's pattern)."""
    w = Window.partitionBy(id_col).orderBy("seq")
    rows = tokens
    for i, _ in enumerate(types):
        rows = rows.withColumn(f"__t{i}", F.lead("type", i).over(w)).withColumn(f"__v{i}", F.lead("value", i).over(w))
    hit = F.lit(True)
    for i, t in enumerate(types):
        hit = hit & (F.col(f"__t{i}") == t)
    return rows.where(hit).select(id_col, "seq", F.array(*[F.col(f"__v{i}") for i in range(len(types))]).alias("matched"))
