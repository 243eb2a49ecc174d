"""Parsing, graphs, selection, symbols and diagnostics on small cases."""

import pytest
from pyspark.sql import functions as F

from glyphflow.glr import Parser, step_budget
from glyphflow.grammar import read_grammar
from glyphflow.lexer import Lexer
from glyphflow.ml.features import prune
from glyphflow.operators import diagnostics, graph, parse, select, symbols
from glyphflow.plans.queries_parse import LISTS, SUMS


def run(grammar, text, **how):
    tokens = Lexer(grammar.lexer_rules()).greedy(text).tokens
    return Parser(grammar, **how)(tokens, len(text.encode()))


def test_spans_of_left_recursion():
    r = run(LISTS, "   42 7")
    spans = {(n.name, n.start, n.length) for n, _ in r.nodes}
    assert {("NUM", 3, 2), ("NUM", 6, 1), ("list", 3, 2), ("list", 3, 4), ("start", 3, 4)} == spans and r.success_full and r.parses == 1


@pytest.mark.parametrize("n", [1, 2, 8, 200])
def test_closed_forms(n):
    r = run(SUMS, "+".join("7" * n))
    assert (len(r.nodes), len(r.packed), len(r.edges), len(r.resolved), r.parses) == (3 * n, n + 1, 3 * n - 1, 2 * n - 1, 1)


def test_prefix_and_complete_parses():
    r = run(SUMS, "1+2+")
    assert r.success_prefix and not r.success_full
    grammar = read_grammar("<A> ::= 'a'\n<B> ::= 'b'\n<s> ::= <A> <B>")
    both = run(grammar, "ab", prefixes=True)
    assert both.parses == both.resting == 2 and both.nodes[0][0].type == 300 and run(grammar, "ab").parses == 1
    assert not run(grammar, "ba").success_full and run(grammar, "").parses == 0


@pytest.mark.parametrize(("text", "parses"), [("( 'a' | 'a' 'a' )+", True), ("( ( 'a' )* 'a' )+", True)])
@pytest.mark.parametrize("n", [8, 64])
def test_ambiguous_grammars_end(text, parses, n):
    r = run(read_grammar(f"<s> ::= {text}"), "a" * n)
    assert r.success_prefix is parses and r.steps <= step_budget(n)


def test_dangling_else_and_catalan():
    g = read_grammar("<s> ::= 'i' <s> | 'i' <s> 'e' <s> | 'x'")
    assert run(g, "iixex").success_full
    catalan = read_grammar("<s> ::= 'a' <s> <s> | 'a'")
    assert run(catalan, "a" * 9, budget=0).success_full
    assert run(catalan, "a" * 64).success_prefix  # the beam may lose the complete parse, but it ends


def test_preconditions_actions_and_pruner():
    g = read_grammar("<N> ::= /[0-9]+/\n<s> ::= <N> => { $1 }")
    assert [n.value for n, _ in run(g, "12").nodes] == ["12", "12"]
    # Without its rule the number only rests as itself.
    barred = run(g, "12", preconditions={"s": lambda rule, context: False})
    assert not any(n.type == 200 for n, _ in barred.nodes)
    assert run(g, "12", actions={"s": lambda rule, children: 1 / 0}).nodes[0][0].value is None
    assert run(SUMS, "1+2+3", pruner=prune).success_full


def test_resume_from_a_snapshot_is_the_cold_parse():
    text = "+".join("1234567")
    tokens = Lexer(SUMS.lexer_rules()).greedy(text).tokens
    parser = Parser(SUMS)
    from glyphflow.glr import _Run

    cold = _Run(parser, tokens, len(text), 4, None, False)
    at, paths = cold.result.snapshots[1]
    warm = _Run(parser, tokens, len(text), 0, (at, list(paths), cold.forest, cold.next_number, cold.lineage), False)
    shape = lambda r: sorted((n.name, n.start, n.length, d) for n, d in r.result.nodes)
    assert warm.result.steps < cold.result.steps and shape(warm) == shape(cold)


def test_graph_analytics_of_a_drawn_graph(spark):
    nodes = [(1, i, t, s, 1) for i, t, s in ((1, 100, 0), (2, 101, 1), (3, 100, 2), (4, 101, 3), (5, 100, 4))] + [(1, 6, 200, 0, 3), (1, 7, 200, 0, 5)]
    edges = [(1, 10, 6, c, k) for k, c in enumerate((1, 2, 3))] + [(1, 11, 7, c, k) for k, c in enumerate((6, 4, 5))]
    nodes += [(2, 1, 100, 0, 1), (2, 2, 300, 0, 1)]
    edges += [(2, 1, 2, 1, 0), (2, 2, 2, 1, 0)]
    n = spark.createDataFrame(nodes, "doc_id int, node_id int, node_type int, source_start int, source_length int")
    e = spark.createDataFrame(edges, "doc_id int, packed_id int, parent_id int, child_id int, child_ordinal int")
    roots = spark.createDataFrame([(1, 7), (2, 2)], "doc_id int, node_id int")
    deep = graph.with_depth(n, e, roots)
    lengths = spark.createDataFrame([(1, 5), (2, 1)], "doc_id int, source_length int")
    got = {r["doc_id"]: r for r in graph.report(deep, e, lengths).collect()}
    assert (got[1]["node_count"], got[1]["max_depth"], got[1]["max_fan_out"], got[1]["average_fan_out"], got[1]["ambiguity_rate"], got[1]["source_coverage"]) == (7, 2, 3, 3.0, 0.0, 1.0)
    assert (got[2]["node_count"], got[2]["max_depth"], got[2]["ambiguity_rate"], got[2]["max_fan_out"]) == (2, 1, 0.5, 1)
    assert {r["node_type"]: r["n"] for r in graph.type_histogram(n).where("doc_id = 1").collect()} == {100: 3, 101: 2, 200: 2}
    assert [(r["node_id"], r["children"]) for r in graph.hotspots(n, e).where("doc_id = 1").orderBy("rank").collect()] == [(6, 3), (7, 3)]
    assert graph.memory_estimate(2, 3) == 512


def test_diagnostics_of_documents(spark):
    docs = spark.createDataFrame([(1, "123 @ 456"), (2, "123\n@@@"), (3, "123"), (4, None), (5, "é 1 @")], "doc_id int, text string")
    grammar = read_grammar("<N> ::= /[0-9]+/\n<W> ::= /é/\n<s> ::= <N> <W>")
    forest = parse.parse(docs, grammar, file_col=None)
    rows = {(r["doc_id"], r["code"]): (r["line"], r["column"], r["position"], r["source_line"]) for r in parse.diagnostics(forest).collect()}
    assert rows[1, "LX1001"] == (1, 5, 4, "123 @ 456") and rows[2, "LX1001"] == (2, 1, 4, "@@@") and rows[5, "LX1001"] == (1, 5, 5, "é 1 @")
    assert not any(k[0] == 4 for k in rows)
    shown = spark.createDataFrame([("LX1001", "error", "Unexpected input", "test.txt", 2, 7, 0, "abc def gh", "")], ", ".join(f"`{n}` {t}" for n, t in diagnostics.DIAGNOSTIC_FIELDS))
    r = shown.select(diagnostics.display().alias("d"), diagnostics.excerpt().alias("e")).first()
    assert r["d"] == "test.txt(2,7): error LX1001: Unexpected input" and r["e"] == r["d"] + "\n    abc def gh\n" + " " * 10 + "^"


def test_scopes(spark):
    declared = spark.createDataFrame([("p", "main", "count", 1, 1), ("p", "main", "count", 2, 2), ("p", "", "top", 3, 3)], "project string, scope string, name string, value int, seq int")
    table = symbols.declare(declared, "seq")
    assert {(r["symbol_ref"], r["value"]) for r in table.collect()} == {("p|main.count", 2), ("p|top", 3)}
    uses = spark.createDataFrame([("count", "main.method.inner"), ("count", "other"), ("top", "main")], "name string, scope string")
    found = {(r["name"], r["scope"]): r["found_scope"] for r in symbols.lookup(uses, table).collect()}
    assert found == {("count", "main.method.inner"): "main", ("count", "other"): None, ("top", "main"): None}
    wide = {(r["name"], r["scope"]): r["found_scope"] for r in symbols.lookup(uses, table, with_global=True).collect()}
    assert wide["top", "main"] == ""
    assert symbols.exists(table.select("symbol_ref"), table.limit(1)).count() == 1 and symbols.in_scope(table, "main").count() == 1
    stack = spark.range(1).select(symbols.context_path(F.expr("transform(array('a', 'b', '', 'c'), x -> named_struct('push', x <> '', 'name', x))")).alias("s")).first()["s"]
    assert stack == ["a", "c"]


def test_extract_and_offsets(spark):
    rows = spark.createDataFrame([(1, 0, 5, "1+2+3"), (1, 2, 1, "2")], "doc_id int, source_start int, source_length int, node_text string")
    assert {(r["change"], r["new_text"]) for r in symbols.extract_variable(rows.limit(1), "x").collect()} == {("declare", "x = 1+2+3"), ("replace", "x")}
    points = spark.createDataFrame([(1, 2), (1, 9)], "doc_id int, offset int")
    assert [(r["offset"], r["node_text"]) for r in select.at_offset(rows, points).collect()] == [(2, "2")]
    docs = spark.createDataFrame([(1, "ab\ncd"), (2, "")], "doc_id int, text string")
    places = spark.createDataFrame([(1, 2, 2), (1, 7, 1)], "doc_id int, line int, column int")
    assert {(r["line"], r["offset"]) for r in select.to_offset(select.line_starts(docs), places).collect()} == {(2, 4), (7, None)}
