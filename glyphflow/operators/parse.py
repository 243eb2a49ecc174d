"""Documents to parse forests, as tables of nodes, packed nodes, edges and a summary row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphflow.glr import PATH_BUDGET, Parser
from glyphflow.grammar import Grammar
from glyphflow.lexer import Lexer, Positions
from glyphflow.operators.diagnostics import DIAGNOSTIC_FIELDS, parse_diagnostics

NODE = "struct<node_id: bigint, node_type: int, rule_name: string, value: string, source_start: bigint, source_length: bigint, is_terminal: boolean, depth: int>"
TOKEN = "struct<type: string, value: string, start_pos: int, length: int>"
FOREST_SCHEMA = (
    "success_prefix boolean, success_full boolean, n_parses int, n_resting int, n_tokens int, n_steps int, source_length int, "
    f"nodes array<{NODE}>, packed array<struct<packed_id: bigint, parent_id: bigint, rule_id: int>>, "
    "edges array<struct<packed_id: bigint, parent_id: bigint, child_id: bigint, child_ordinal: int>>, "
    f"resolved array<{TOKEN}>, diagnostics array<struct<{', '.join(f'{n}: {t}' for n, t in DIAGNOSTIC_FIELDS)}>>"
)


def parse(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", mode: str = "greedy", budget: int = PATH_BUDGET, file_col: str | None = None, preconditions=None, actions=None, pruner=None, prefixes: bool = False) -> DataFrame:
    """id and FOREST_SCHEMA: one row for each document, its forest inside.

    A parse need not take the whole text: success_prefix says that some path rests on a single symbol, success_full
    that it took every token. The forest holds the complete parses where there are any, and with prefixes the parses of
    prefixes beside them. Null text counts as empty. Documents don't meet, so nothing is shuffled.
    """
    out = StructType([docs.schema[id_col], *StructType.fromDDL(FOREST_SCHEMA).fields])
    rules = grammar.lexer_rules()
    arrow = to_arrow_schema(StructType(out.fields[1:]))
    pair = docs.select(F.col(id_col), F.col(text_col).cast("string"), (F.col(file_col).cast("string") if file_col else F.lit("")).alias("__file"))

    def run(batches):
        lexer, parser = Lexer(rules), Parser(grammar, budget, preconditions, actions, pruner=pruner, prefixes=prefixes)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                rows = [_forest(text or "", name, lexer, parser, mode) for text, name in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), *[pa.array([r[f.name] for r in rows], f.type) for f in arrow]], [id_col, *arrow.names])

    return pair.mapInArrow(run, out)


def _forest(text: str, name: str, lexer: Lexer, parser: Parser, mode: str) -> dict:
    length = len(text.encode("utf-8", "surrogatepass"))
    found = lexer.greedy(text) if mode == "greedy" else lexer.explore(text)
    tokens = found.tokens if mode == "greedy" else sorted(found.tokens, key=lambda t: (t.start, t.step))
    result = parser(tokens, length)
    return {
        "success_prefix": result.success_prefix,
        "success_full": result.success_full and found.completed,
        "n_parses": result.parses,
        "n_resting": result.resting,
        "n_tokens": len(tokens),
        "n_steps": result.steps,
        "source_length": length,
        "nodes": [{"node_id": n.id, "node_type": n.type, "rule_name": n.name, "value": n.value, "source_start": n.start, "source_length": n.length, "is_terminal": n.type == 100, "depth": d} for n, d in result.nodes],
        "packed": [{"packed_id": a, "parent_id": b, "rule_id": c} for a, b, c in result.packed],
        "edges": [{"packed_id": a, "parent_id": b, "child_id": c, "child_ordinal": d} for a, b, c, d in result.edges],
        "resolved": [{"type": t.type, "value": t.value, "start_pos": t.start, "length": t.end - t.start} for t in result.resolved],
        "diagnostics": parse_diagnostics(text, name, found, tokens, result, Positions(text)),
    }


def _exploded(forest: DataFrame, id_col: str, column: str) -> DataFrame:
    return forest.select(id_col, F.explode(column).alias("__x")).select(id_col, "__x.*")


def nodes(forest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _exploded(forest, id_col, "nodes")


def packed_nodes(forest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _exploded(forest, id_col, "packed")


def edges(forest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _exploded(forest, id_col, "edges")


def resolved_tokens(forest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return forest.select(id_col, F.posexplode("resolved").alias("seq", "__x")).select(id_col, "seq", "__x.*")


def diagnostics(forest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return _exploded(forest, id_col, "diagnostics")


def summary(forest: DataFrame) -> DataFrame:
    """One row over many documents: files, parsed files, tokens, errors; a run succeeds if one file does."""
    return forest.agg(
        F.count("*").alias("n_files"),
        F.sum(F.col("success_prefix").cast("long")).alias("n_parsed"),
        F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"),
        F.sum(F.size("diagnostics").cast("long")).alias("n_diagnostics"),
        F.bool_or("success_prefix").alias("success"),
    )


def merge_graphs(forests: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Nodes of several forests as one table; (graph, id, node_id) names a node."""
    tables = [nodes(f, id_col).withColumn("graph", F.lit(i)) for i, f in enumerate(forests)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def path_labels(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", mode: str = "exploratory") -> DataFrame:
    """id, step, path_id, features, label: paths of crowded steps, labelled by whether a parse came of them."""
    rules = grammar.lexer_rules()
    pair = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    out = StructType([pair.schema[0], *StructType.fromDDL("seq int, path_id int, features array<double>, label int").fields])

    def run(batches):
        lexer, parser = Lexer(rules), Parser(grammar, budget=64)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = lexer.greedy(text or "") if mode == "greedy" else lexer.explore(text or "")
                tokens = sorted(found.tokens, key=lambda t: (t.start, t.step))
                own = parser(tokens, len((text or "").encode()), label=True).labels
                rows += [(k, n, f, y) for k, (n, f, y) in enumerate(own)]
                ids += [i] * len(own)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32()]
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "seq", "path_id", "features", "label"])

    return pair.mapInArrow(run, out)
