"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's spark.checkpoint.dir. Only a local master may do without one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="glyphflow-checkpoint-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; an executor's loss doesn't repeat what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The settled rows and their number, which is taken as they are written and not by a job of its own."""
    seen = Observation()
    return settled(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that the caller wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def name_of(column: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def carried(docs: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(name_of(c)) for c in docs.columns]).alias(name)


def apart(docs: DataFrame, **own: str) -> DataFrame:
    """doc, a struct of all columns but the named ones, and these under new names: apart(docs, id="doc_id")."""
    others = [c for c in docs.columns if c not in own.values()]
    return docs.select(F.struct(*[F.col(name_of(c)) for c in others] or [F.lit(0).alias("none")]).alias("doc"), *[F.col(name_of(c)).alias(n) for n, c in own.items()])


def together(docs: DataFrame, **own: Column) -> list[Column]:
    """The columns of docs out of a frame that came apart; own gives those that aren't in its struct, by their name."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return [own[c].cast(kinds[c]).alias(c) if c in own else F.col("doc").getField(c).alias(c) for c in docs.columns]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_of_id(column: str):
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
