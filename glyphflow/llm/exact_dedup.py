"""Exact dedup that takes frequent texts out before the shuffle.

Misra-Gries counting (Spark's frequent-items aggregate) names every digest that may hold more than ``support`` of the
rows; an exact count verifies them. The verified winners, at most 1/support rows, are broadcast, and their members are
decided where they lie. All other digests meet in an ordinary shuffle, where no group exceeds ``support`` of the rows,
nor HEAVY_ROWS rows while the table has less than MOST_COUNTERS times as many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

SUPPORT = 1 / 512
#: A digest of more rows than this counts as frequent where the counters allow it: there are MOST_COUNTERS at most.
HEAVY_ROWS, MOST_COUNTERS = 200_000, 1 << 15


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays, a null id
    ranking lowest; of rows that also share the id, exactly one stays. An empty table gives no rows.
    """
    digests = settled(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    last = F.max(F.struct("doc_id", "row"))
    n = digests.count()
    support = max(min(support, HEAVY_ROWS / max(n, 1)), 1 / MOST_COUNTERS)
    # The aggregate's table compares strings by value, but byte arrays by address.
    frequent = digests.select(F.hex("digest").alias("h")).stat.freqItems(["h"], support)
    frequent = frequent.select(F.explode(F.array_distinct("h_freqItems")).alias("h")).select(F.unhex("h").alias("digest"))
    counted = digests.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), last.alias("keep"))
    winners = settled(counted.where(F.col("group_size") > F.lit(support * n)))
    heavy = digests.join(F.broadcast(winners), "digest").select("doc_id", "digest", "row", "group_size", "keep")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    light = light.select("doc_id", "digest", "row", F.count("*").over(group).alias("group_size"), last.over(group).alias("keep"))
    decided = heavy.unionByName(light)
    return decided.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
