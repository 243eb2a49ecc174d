"""The query catalogue: name -> (Spark query, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a (spark, sf_dir) -> DataFrame function under its name."""

    def keep(run):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy by row: dealt out to all cores where it came in fewer parts than these.

    Read without vectored IO, which holds a row group's whole texts a second time outside the heap.
    """
    rows = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Grouped rows before work that is heavy by row: AQE would join them into as few parts as their bytes fill."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
