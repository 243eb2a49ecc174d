"""Measurement statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, least, exact interpolated percentiles pNN, and most."""
    named = [F.percentile(value, p).alias(f"p{round(p * 100)}") for p in points]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), *named, F.max(value).alias("most"))


def nearest_rank(rows: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles that are values of the data: the smallest with at least that share at or below it."""
    return rows.groupBy(*by).agg(*[F.percentile_disc(value, p).alias(f"p{round(p * 100)}") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points])


def linear_fit(rows: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2 of least squares, and growth: mean y per x of the largest x over that of the smallest."""
    out = rows.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.max_by(F.col(y) / F.col(x), F.col(x)).alias("__l"), F.min_by(F.col(y) / F.col(x), F.col(x)).alias("__f"))
    return out.withColumn("growth", F.col("__l") / F.col("__f")).drop("__l", "__f")


def scaling_exponent(rows: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """The slope of log y over log x."""
    kept = rows.where((F.col(x) > 0) & (F.col(y) > 0))
    return kept.groupBy(*(by or [])).agg(F.regr_slope(F.log(F.col(y)), F.log(F.col(x))).alias("exponent"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.corr(x, y).alias("r"))


def pass_rate(rows: DataFrame, by: str, passed: str = "passed") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("n_passed"), (F.count_if(F.col(passed)) / F.count("*")).alias("rate"))


def wasted_ratio(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """attempts, wasted and their ratio over lex_status rows."""
    out = rows.groupBy(*(by or [])).agg(F.sum("attempts").alias("attempts"), F.sum("wasted").alias("wasted"))
    return out.withColumn("ratio", F.when(F.col("attempts") > 0, F.col("wasted") / F.col("attempts")).otherwise(0.0))
