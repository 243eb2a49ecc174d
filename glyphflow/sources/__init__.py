"""Texts in, tables out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import decode_with_bom

SOURCE_COLUMNS = ["doc_id", "file_name", "text", "n_bytes"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's checkpoint folder; only a local master may do without one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphflow-checkpoint-"))
    return df.checkpoint(eager=True)


def _shaped(df: DataFrame) -> DataFrame:
    return df.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0))).select(*SOURCE_COLUMNS)


def from_strings(spark: SparkSession, texts: list[str], names: list[str] | None = None) -> DataFrame:
    """In-memory texts as sources."""
    names = names or [""] * len(texts)
    return _shaped(spark.createDataFrame([(str(i), n, t) for i, (n, t) in enumerate(zip(names, texts, strict=True))], "doc_id string, file_name string, text string"))


def from_bytes(df: DataFrame, bytes_col: str, id_col: str = "doc_id", name_col: str | None = None) -> DataFrame:
    """A column of UTF-8 bytes as sources; malformed sequences become U+FFFD."""
    name = F.col(name_col).cast("string") if name_col else F.lit("")
    return _shaped(df.select(F.col(id_col).cast("string").alias("doc_id"), name.alias("file_name"), F.expr(f"make_valid_utf8(cast(`{bytes_col}` as string))").alias("text")))


def from_column(df: DataFrame, text_col: str, id_col: str, name_col: str | None = None) -> DataFrame:
    name = F.col(name_col).cast("string") if name_col else F.lit("")
    return _shaped(df.select(F.col(id_col).cast("string").alias("doc_id"), name.alias("file_name"), F.col(text_col).cast("string").alias("text")))


def from_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row for each file, decoded by its byte-order mark (UTF-8 without one), the mark left out."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.load(path).select(F.col("path").alias("doc_id"), F.col("path").alias("file_name"), decode_with_bom(F.col("content")).alias("text"))
    return _shaped(rows)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """Results as parquet, json (lines) or csv; nested columns become JSON text in csv."""
    if form == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
        df.write.mode(mode).option("header", True).csv(path)
    else:
        getattr(df.write.mode(mode), form)(path)
