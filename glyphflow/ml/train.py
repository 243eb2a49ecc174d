"""Training by Newton steps over sufficient statistics that Spark sums; evaluation as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIDGE, HOLD_OUT = 1e-3, 5


def _z(weights, k: int) -> Column:
    z = F.lit(0.0)
    for i in range(k):
        z = z + F.lit(float(weights[i])) * F.col("features")[i]
    return z


def train(labels: DataFrame, ridge: float = RIDGE, steps: int = 25) -> list[float]:
    """Weights of a logistic model on (features array<double>, label int); the first feature is the bias.

    Each step is one aggregate of k(k+1)/2 + k sums; the ridge leaves the bias alone.
    """
    first = labels.select(F.size("features").alias("k")).first()
    if first is None:
        return []
    k = first["k"]
    w, n = np.zeros(k), labels.count()
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_z(w, k)))
        rows = labels.select("features", F.col("label").cast("double").alias("y"), p.alias("p"))
        sums = [F.sum((F.col("y") - F.col("p")) * F.col("features")[i]) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums += [F.sum(F.col("p") * (1 - F.col("p")) * F.col("features")[i] * F.col("features")[j]) for i, j in pairs]
        got = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        keep = np.diag([1e-9, *[ridge] * (k - 1)])
        gradient = np.array(got[:k]) / n - keep @ w
        hessian = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:], strict=True):
            hessian[i, j] = hessian[j, i] = v / n
        step = np.linalg.solve(hessian + keep + 1e-12 * np.eye(k), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return [float(x) for x in w]


def hold_out(labels: DataFrame, order: str, every: int = HOLD_OUT) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, and every fifth by the order column."""
    held = F.col(order) % every == every - 1
    return labels.where(~held), labels.where(held)


def evaluate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, log_loss, accuracy and auc of (probability, label), by groups; ties share their mean rank."""
    by = by or []
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("probability")))
    # Ranks come from counts of equal scores, so no window holds more than the distinct scores.
    bins = scored.groupBy(*by, "probability").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"), F.sum(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bins.withColumn("rank", below + (F.col("n") + 1) / 2)
    right = F.when(F.col("probability") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("loss").alias("loss"), F.sum(right).alias("right"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    negatives = F.col("n") - F.col("pos")
    auc = F.when((F.col("pos") > 0) & (negatives > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * negatives))
    return out.select(*by, "n", (F.col("loss") / F.col("n")).alias("log_loss"), (F.col("right") / F.col("n")).alias("accuracy"), auc.alias("auc"))
