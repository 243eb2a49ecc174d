"""Grammar algebra over rule tables: token_rules(name, pattern, priority ...) and production_rules(name, rhs ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("BaseWins", "OverlayWins", "Additive", "PriorityBased")


def _symbols(productions: DataFrame) -> DataFrame:
    return productions.select(F.explode("rhs").alias("name")).distinct()


def root_rules(productions: DataFrame) -> DataFrame:
    """Left-hand sides that no right-hand side mentions."""
    return productions.select("name").distinct().join(_symbols(productions), "name", "left_anti")


def undefined(productions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Symbols that neither table defines and that aren't literals or regexes."""
    known = productions.select("name").unionByName(tokens.select("name")).distinct()
    return _symbols(productions).where(~F.col("name").rlike(r"^(['\"].+['\"]|/.+/)$")).join(known, "name", "left_anti")


def ignorable(tokens: DataFrame, productions: DataFrame) -> DataFrame:
    """Whitespace-only token rules that no production mentions; tokens hold is_whitespace."""
    return tokens.where("is_whitespace").select("name").distinct().join(_symbols(productions), "name", "left_anti")


def literal_rules(productions: DataFrame, tokens: DataFrame) -> DataFrame:
    """literal, rule: the token rule that each quoted symbol uses; its own text where no rule has that literal."""
    used = _symbols(productions).where(F.col("name").rlike("^(['\"]).+\\1$")).withColumn("core", F.expr("substring(name, 2, length(name) - 2)"))
    own = tokens.where(F.col("pattern").rlike("^(['\"]).+\\1$") & (F.coalesce("context", F.lit("")) == "")).groupBy(F.expr("substring(pattern, 2, length(pattern) - 2)").alias("core")).agg(F.min_by("name", "ordinal").alias("rule"))
    return used.join(own, "core", "left").select(F.col("name").alias("literal"), F.coalesce("rule", "name").alias("rule"))


def overlay_tokens(base: DataFrame, overlay: DataFrame, policy: str = "OverlayWins") -> DataFrame:
    """name, pattern, priority, origin of the composite's token rules, and whether both defined the name."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    b, o = (t.select("name", F.col("pattern").alias(f"{k}_pattern"), F.col("priority").alias(f"{k}_priority")) for k, t in (("b", base), ("o", overlay)))
    both = F.col("b_pattern").isNotNull() & F.col("o_pattern").isNotNull()
    wins = {"OverlayWins": F.lit(True), "PriorityBased": F.col("o_priority") >= F.col("b_priority")}.get(policy, F.lit(False))
    take = F.col("b_pattern").isNull() | (both & wins)
    rows = b.join(o, "name", "full")
    pick = lambda c: F.when(take, F.col(f"o_{c}")).otherwise(F.col(f"b_{c}"))
    return rows.select("name", pick("pattern").alias("pattern"), pick("priority").alias("priority"), F.when(take, "overlay").otherwise("base").alias("origin"), both.alias("conflict"))


def overlay_productions(base: DataFrame, overlay: DataFrame, policy: str = "OverlayWins") -> DataFrame:
    """name, rhs, precedence, origin of the composite's productions."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    most = [t.groupBy("name").agg(F.max("precedence").alias(f"{k}_most")) for k, t in (("b", base), ("o", overlay))]
    rows = base.withColumn("origin", F.lit("base")).unionByName(overlay.withColumn("origin", F.lit("overlay")))
    rows = rows.join(most[0], "name", "left").join(most[1], "name", "left")
    alone = F.col("b_most").isNull() | F.col("o_most").isNull()
    kept = {"BaseWins": F.lit("base"), "OverlayWins": F.lit("overlay"), "PriorityBased": F.when(F.col("o_most") >= F.col("b_most"), "overlay").otherwise("base")}.get(policy, F.col("origin"))
    return rows.where(alone | (F.col("origin") == kept)).select("name", "rhs", "precedence", "origin")


def ancestors(spark, links: DataFrame) -> DataFrame:
    """name, ancestor, depth over (name, inherits) links; a cycle's names are their own ancestors."""
    from glyphflow.sources import cut_lineage

    links = links.select("name", F.col("inherits").alias("ancestor")).distinct()
    found = cut_lineage(links.withColumn("depth", F.lit(1)))
    frontier, depth = found, 1
    while not frontier.isEmpty():
        depth += 1
        onward = frontier.select("name", F.col("ancestor").alias("via")).join(links.select(F.col("name").alias("via"), "ancestor"), "via").select("name", "ancestor").distinct()
        frontier = cut_lineage(onward.join(found, ["name", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    return found
