"""One row of each group, without moving the rows that are in none."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, settled, slices, together

#: Up to so many rows of ids and marks (some 24 bytes each) go to all tasks; beyond, the joins are shuffled.
BROADCAST_ROWS = 1 << 20


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, mark: Callable[[str | None], int | None]) -> DataFrame:
    """The input's rows less those of a group that aren't its first: smallest id, then smallest mark, null ids last.

    groups holds doc_id, mark (of the row's text, as the function gives it) and root (the group) of every row that is in
    one. Of rows that share both id and mark one stays; a row that is in no group stays. Only rows whose id is in a group
    of two rows or more are marked and compared; the others stay where they are while such rows are at most
    BROADCAST_ROWS. The columns are the input's, whatever their names.
    """
    held = groups.groupBy("doc_id", "mark", "root").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    heads = held.groupBy("root").agg(F.min(rank).alias("head"), F.sum("n").alias("rows")).where("rows > 1")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))
    told = settled(held.join(heads, "root").select("doc_id", "mark", "n", first.alias("stays")))
    near = F.broadcast if told.count() <= BROADCAST_ROWS else lambda frame: frame
    rows = apart(docs, t=text_col).withColumn("k", F.col("doc").getField(id_col).cast("long"))
    back = together(docs, **{text_col: F.col("t")})
    ids = told.select("doc_id").distinct()
    same = F.col("k").eqNullSafe(F.col("doc_id"))
    others = rows.join(near(ids), same, "left_anti").select(*back)

    def marked(batches):
        for part in slices(batches):
            yield pa.record_batch([*part.columns, pa.array([mark(t) for t in part.column(1).cast(pa.string()).to_pylist()], pa.int64())], ["doc", "t", "k", "m"])

    kinds = T.StructType([*rows.schema.fields, T.StructField("m", T.LongType())])
    suspects = rows.join(near(ids), same, "left_semi").mapInArrow(marked, kinds)
    judged = suspects.join(near(told), same & (F.col("m") == F.col("mark")), "left")
    once = judged.where(F.coalesce(F.col("stays") & (F.col("n") == 1), F.col("stays").isNull())).select(*back)
    again = judged.where("stays AND n > 1").dropDuplicates(["k", "m"]).select(*back)
    return others.unionByName(once).unionByName(again)
