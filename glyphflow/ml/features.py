"""Features and logistic scores of the rule and path models; the same sums as Spark columns."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.rules import CompiledRule

# Feature order and default weights of the two models.
RULE_FEATURES = ["bias", "literal_hit", "digit", "letter", "space", "regex", "skippable", "context", "literal_miss", "non_ascii"]
RULE_WEIGHTS = [-0.30, 2.00, 1.50, 1.50, 1.20, 0.10, 0.20, -0.20, -0.50, 0.20]
PATH_FEATURES = ["bias", "score_deficit", "position_deficit", "stalled", "low_score", "age"]
PATH_WEIGHTS = [-3.00, 2.00, 3.00, 1.50, 1.00, 0.10]
PATH_THRESHOLD, MIN_PATHS = 0.9, 10
DISABLE_ALL = "GLYPHFLOW_ML_DISABLE_ALL"
FEATURES = ("rule_prioritization", "path_pruning")


class Switch:
    """Which learned features are on, and with which model version; all are off at first."""

    def __init__(self):
        self.versions: dict[str, str] = {}

    def enable(self, feature: str, version: str = "0.1.0") -> None:
        if feature not in FEATURES:
            raise ValueError(f"unknown feature {feature}")
        self.versions[feature] = version

    def disable(self, feature: str) -> None:
        self.versions.pop(feature, None)

    def is_enabled(self, feature: str) -> bool:
        return feature in self.versions and os.environ.get(DISABLE_ALL, "").lower() not in ("1", "true")

    def status(self) -> str:
        return "; ".join(f"{f}: {'on ' + self.versions[f] if self.is_enabled(f) else 'off'}" for f in FEATURES)


def logistic(weights: list[float], features: list[float]) -> float:
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, features, strict=True))))


def rule_features(rule: CompiledRule, first: int) -> list[float]:
    """Of a rule at a position whose first byte is given."""
    regex = len(rule.pattern) > 1 and rule.pattern[0] == rule.pattern[-1] == "/"
    core = rule.pattern
    if not regex and len(core) >= 2 and core[0] in "\"'" and core[-1] == core[0]:
        core = core[1:-1]
    hit = not regex and core != "" and ord(core[0]) & 0xFF == first
    miss = not regex and core != "" and not hit
    letter = 65 <= first <= 90 or 97 <= first <= 122
    space = any(x in rule.pattern for x in ("\\s", " \\t", "[ \\t"))
    return [float(x) for x in (1, hit, regex and 48 <= first <= 57 and "[0-9]" in rule.pattern, regex and letter and "[a-zA-Z]" in rule.pattern, regex and first in (32, 9, 13, 10) and space, regex, rule.skippable, bool(rule.context), miss, first >= 0x80)]


def rule_probability(rule: CompiledRule, first: int, weights: list[float] = RULE_WEIGHTS) -> float:
    return logistic(weights, rule_features(rule, first))


def path_features(score: float, position: int, last_start: int, number: int, best_score: float, best_position: int, tokens: int) -> list[float]:
    deficit = 0.0 if best_score <= 0 else min(1.0, max(0.0, 1 - score / best_score))
    behind = 0.0 if best_position <= 0 else min(1.0, max(0.0, (best_position - position) / best_position))
    return [1.0, deficit, behind, float(last_start < 0), float(score < 0.5), number / (tokens + 1)]


def prune(paths: list, tokens: int, weights: list[float] = PATH_WEIGHTS, threshold: float = PATH_THRESHOLD, min_paths: int = MIN_PATHS) -> list:
    """The paths less those that the model holds for doomed; a beam that is small enough stays whole."""
    if len(paths) <= min_paths:
        return paths
    best, deepest = max(float(p.score) for p in paths), max(p.position for p in paths)
    return [p for p in paths if logistic(weights, path_features(float(p.score), p.position, p.last_start, p.number, best, deepest, tokens)) < threshold]


def _sum(weights: list[float], columns: list[Column]) -> Column:
    z = F.lit(0.0)
    for w, c in zip(weights, columns, strict=True):
        z = z + F.lit(w) * c.cast("double")
    return 1 / (1 + F.exp(-z))


def score_rules(rules: DataFrame, first_byte: str = "first_byte", weights: list[float] = RULE_WEIGHTS) -> DataFrame:
    """Adds probability to rows of pattern, is_skippable, context and first_byte."""
    p, b = F.col("pattern"), F.col(first_byte)
    regex = (F.length(p) > 1) & p.startswith("/") & p.endswith("/")
    core = F.when(p.rlike("^'.*'$") & (F.length(p) >= 2) | p.rlike('^".*"$') & (F.length(p) >= 2), F.expr("substring(pattern, 2, length(pattern) - 2)")).otherwise(p)
    hit = ~regex & (F.length(core) > 0) & (F.ascii(core) % 256 == b)
    letter = b.between(65, 90) | b.between(97, 122)
    space = p.contains("\\s") | p.contains(" \\t") | p.contains("[ \\t")
    columns = [F.lit(True), hit, regex & b.between(48, 57) & p.contains("[0-9]"), regex & letter & p.contains("[a-zA-Z]"), regex & b.isin(32, 9, 13, 10) & space, regex, F.col("is_skippable"), F.coalesce(F.col("context"), F.lit("")) != "", ~regex & (F.length(core) > 0) & ~hit, b >= 0x80]
    return rules.withColumn("probability", _sum(weights, [c.cast("int") for c in columns]))


def score_paths(paths: DataFrame, weights: list[float] = PATH_WEIGHTS) -> DataFrame:
    """Adds probability to rows of score, position, last_start, number, best_score, best_position and tokens."""
    best, deepest = F.col("best_score"), F.col("best_position")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    columns = [F.lit(1.0), F.when(best <= 0, 0.0).otherwise(unit(1 - F.col("score") / best)), F.when(deepest <= 0, 0.0).otherwise(unit((deepest - F.col("position")) / deepest)), (F.col("last_start") < 0).cast("int"), (F.col("score") < 0.5).cast("int"), F.col("number") / (F.col("tokens") + 1)]
    return paths.withColumn("probability", _sum(weights, columns))
