"""Symbols, references and refactorings as joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualified(scope: Column, name: Column) -> Column:
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat_ws(".", scope, name))


def symbol_ref(project: Column, scope: Column, name: Column) -> Column:
    return F.concat_ws("|", project, qualified(scope, name))


def declare(rows: DataFrame, order: str) -> DataFrame:
    """The symbol table of declarations (project, scope, name ...): the last declaration of a symbol stands."""
    keyed = rows.withColumn("symbol_ref", symbol_ref(F.col("project"), F.col("scope"), F.col("name")))
    others = [c for c in keyed.columns if c not in ("symbol_ref", order)]
    last = keyed.groupBy("symbol_ref").agg(F.max(F.struct(order, *others)).alias("__b"))
    return last.select(*[F.col(f"__b.{c}").alias(c) for c in rows.columns], "symbol_ref")


def scope_chain(scope: Column, with_global: bool = False) -> Column:
    """The scope and its dotted parents, nearest first."""
    parts = F.split(scope, r"\.")
    chain = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))
    return F.array_distinct(F.concat(chain, F.array(F.lit("")))) if with_global else chain


def lookup(uses: DataFrame, symbols: DataFrame, with_global: bool = False) -> DataFrame:
    """uses (name, scope ...) with found_scope and found_ref: the declaration in the nearest scope, or null.

    Each use looks at its own scopes only, so the join is on (scope, name).
    """
    rows = uses.withColumn("__u", F.monotonically_increasing_id())
    chain = rows.select("__u", "name", F.posexplode(scope_chain(F.col("scope"), with_global)).alias("__far", "__scope"))
    known = symbols.select(F.col("name"), F.coalesce("scope", F.lit("")).alias("__scope"), F.col("symbol_ref").alias("__ref"))
    near = chain.join(known, ["name", "__scope"]).groupBy("__u").agg(F.min(F.struct("__far", "__scope", "__ref")).alias("__b"))
    return rows.join(near, "__u", "left").select(*uses.columns, F.col("__b.__scope").alias("found_scope"), F.col("__b.__ref").alias("found_ref"))


def in_scope(symbols: DataFrame, scope: str) -> DataFrame:
    return symbols.where(F.coalesce("scope", F.lit("")) == scope)


def exists(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return refs.join(symbols, "symbol_ref", "left_semi")


def usages(references: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    found = references.where(F.col("symbol") == name)
    return found if scope is None else found.where(F.col("scope") == scope)


def rename_edits(references: DataFrame, old: str, new: str, scope: str | None = None) -> DataFrame:
    """Code changes that rename a symbol: the reference's place, the old text and the new."""
    return usages(references, old, scope).withColumn("old_text", F.lit(old)).withColumn("new_text", F.lit(new))


def extract_variable(selected: DataFrame, name: str, value_col: str = "node_text") -> DataFrame:
    """Code changes that put selected spans into a variable: its declaration, and the name in the span's place."""
    declared = selected.select("*", F.concat(F.lit(f"{name} = "), F.col(value_col)).alias("new_text"), F.lit("declare").alias("change"))
    used = selected.select("*", F.lit(name).alias("new_text"), F.lit("replace").alias("change"))
    return declared.unionByName(used)


def inline_variable(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Code changes that put a symbol's value where it is used; symbols say which they are by can_inline."""
    values = symbols.where("can_inline").select(F.col("name").alias("symbol"), F.col("value").alias("new_text"))
    return references.join(values, "symbol")


@dataclass(frozen=True)
class Operation:
    """A refactoring: the contexts it is for (none: all), a condition on the place, and what it does to a table."""

    name: str
    contexts: tuple[str, ...] = ()
    condition: Column | None = None
    apply: Callable[[DataFrame], DataFrame] | None = None


OPERATIONS: dict[str, Operation] = {}


def register_operation(operation: Operation) -> None:
    OPERATIONS[operation.name] = operation


def applicable(places: DataFrame, operations: list[Operation] | None = None) -> DataFrame:
    """places (context ...) with the names of the operations that fit, one row for each."""
    options = []
    for o in operations if operations is not None else list(OPERATIONS.values()):
        fits = F.lit(True) if not o.contexts else F.col("context").isin(*o.contexts)
        fits = fits if o.condition is None else fits & o.condition
        options.append(F.when(fits, F.lit(o.name)))
    return places.withColumn("operation", F.explode(F.array_compact(F.array(*options)))) if options else places.withColumn("operation", F.lit("")).limit(0)


def context_depth(tokens: DataFrame, opening: list[str], closing: list[str], id_col: str = "doc_id") -> DataFrame:
    """Adds depth: contexts open after the token."""
    step = F.when(F.col("type").isin(*opening), 1).when(F.col("type").isin(*closing), -1).otherwise(0)
    w = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("depth", F.sum(step).over(w).cast("int"))


def context_path(events: Column) -> Column:
    """The stack after an array of structs (push boolean, name string), outermost first."""
    return F.aggregate(events, F.array().cast("array<string>"), lambda stack, e: F.when(e["push"], F.concat(stack, F.array(e["name"]))).otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))))
