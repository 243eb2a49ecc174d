"""Parsing, graph, selection, symbol, session and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.functions.text import is_ascii
from glyphflow.grammar import read_grammar
from glyphflow.grammar.compose import compose_text
from glyphflow.grammar.ebnf import Normalizer
from glyphflow.ml import features, train
from glyphflow.operators import grammar_relations as R
from glyphflow.operators import graph, parse, select, stats, symbols
from glyphflow.operators import lex as L
from glyphflow.plans.catalog import dealt, register, table, texts
from glyphflow.plans.queries_lex import KEYWORDS, PROPS
from glyphflow.rules import compile_rule
from glyphflow.streaming import session

SUMS = read_grammar(r"""
Grammar: Sums
<NUM> ::= /[0-9]+/
<PLUS> ::= '+'
<start> ::= <expr>
<expr> ::= <NUM> <PLUS> <expr> | <NUM>
""")
LEFT_SUMS = read_grammar(r"""
Grammar: LeftSums
<NUM> ::= /[0-9]+/
<PLUS> ::= '+'
<start> ::= <expr>
<expr> ::= <expr> <PLUS> <NUM> | <NUM>
""")
LISTS = read_grammar(r"""
Grammar: Lists
<NUM> ::= /[0-9]+/
<start> ::= <list>
<list> ::= <list> <NUM> | <NUM>
""")


def _sums(spark, sf):
    """One sum for each order: its lines' quantities, in line order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q")))).alias("x"))
    return dealt(lines.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["q"]), "+").alias("text")))


_SUM_SQL = "s AS (SELECT l_orderkey, count(*) AS n, sum(strlen(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))) + count(*) - 1 AS bytes FROM lineitem GROUP BY 1)"


@register("parse_success_by_doc", f"WITH {_SUM_SQL} SELECT l_orderkey, true AS success_prefix, true AS success_full, 1 AS n_parses, CAST(2 * n - 1 AS INTEGER) AS n_tokens, CAST(bytes AS INTEGER) AS source_length FROM s")
def parse_success_by_doc(spark, sf):
    return parse.parse(_sums(spark, sf), SUMS, "l_orderkey").select("l_orderkey", "success_prefix", "success_full", "n_parses", "n_tokens", "source_length")


@register("parse_node_counts", f"WITH {_SUM_SQL} SELECT l_orderkey, 3 * n AS n_nodes, n + 1 AS n_packed, 3 * n - 1 AS n_edges, 2 * n - 1 AS n_resolved FROM s")
def parse_node_counts(spark, sf):
    forest = parse.parse(_sums(spark, sf), SUMS, "l_orderkey")
    return forest.select("l_orderkey", *[F.size(c).cast("long").alias(f"n_{n}") for c, n in (("nodes", "nodes"), ("packed", "packed"), ("edges", "edges"), ("resolved", "resolved"))])


@register("parse_json_props", "SELECT event_id, true AS success_full, 7 AS n_nodes, 2 AS max_depth FROM events")
def parse_json_props(spark, sf):
    forest = parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props")
    return forest.select("event_id", "success_full", F.size("nodes").alias("n_nodes"), F.array_max(F.transform("nodes", lambda n: n["depth"])).alias("max_depth"))


@register("parse_spans", """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem),
p AS (SELECT *, coalesce(sum(strlen(q) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT l_orderkey, CAST(start AS BIGINT) AS source_start, CAST(strlen(q) AS BIGINT) AS source_length, q AS value FROM p
""")
def parse_spans(spark, sf):
    rows = parse.nodes(parse.parse(_sums(spark, sf), SUMS, "l_orderkey"), "l_orderkey")
    return rows.where("rule_name = 'NUM'").select("l_orderkey", "source_start", "source_length", "value")


@register("parse_left_recursion", """
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents)
SELECT doc_id, n > 0 AS success_full, CAST(CASE WHEN n > 0 THEN 2 * n + 1 ELSE 0 END AS INTEGER) AS n_nodes FROM n
""")
def parse_left_recursion(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), " ").alias("text"))
    return parse.parse(docs, LISTS).select("doc_id", "success_full", F.size("nodes").alias("n_nodes"))


@register("parse_many_files", "SELECT count(*) AS n_files, count(*) AS n_parsed, CAST(5 * count(*) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_diagnostics, true AS success FROM events")
def parse_many_files(spark, sf):
    return parse.summary(parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props"))


@register("parse_diagnostics", "SELECT p_partkey, 'PS2001' AS code, 1 AS line, CAST(strpos(p_name, ' ') + 1 AS INTEGER) AS \"column\", p_name AS source_line FROM part")
def parse_diagnostics(spark, sf):
    """Names lex, but two words are no assignment: the parse fails at the second."""
    grammar = read_grammar("<WORD> ::= /[a-z]+/\n<SET> ::= '='\n<start> ::= <WORD> <SET> <WORD>")
    forest = parse.parse(texts(spark, sf, "part"), grammar, "p_partkey", "p_name")
    return parse.diagnostics(forest, "p_partkey").select("p_partkey", "code", "line", "column", "source_line")


@register("parse_ambiguous_lexing", "SELECT p_partkey, true AS success_full, CAST(CASE WHEN p_name LIKE '% ring' THEN 2 ELSE 1 END AS INTEGER) AS n_parses, p_name LIKE '% ring' AS ambiguous FROM part")
def parse_ambiguous_lexing(spark, sf):
    """A word that also reads as a keyword gives a second parse; both stand under one ambiguous root."""
    grammar = read_grammar("<WORD> ::= /[a-z]+/\n<RING> ::= 'ring'\n<plain> ::= <WORD> <WORD>\n<special> ::= <WORD> <RING>")
    forest = parse.parse(texts(spark, sf, "part"), grammar, "p_partkey", "p_name", mode="exploratory")
    return forest.select("p_partkey", "success_full", "n_parses", F.exists("nodes", lambda n: n["node_type"] == 300).alias("ambiguous"))


_DEPTHS = f"WITH {_SUM_SQL}"


@register("graph_report", f"""
{_DEPTHS}
SELECT l_orderkey, 3 * n AS node_count, 3 * n - 1 AS edge_count, CAST(n + 1 AS INTEGER) AS max_depth,
  round((3 * n - 1) / CAST(n + 1 AS DOUBLE), 9) AS average_fan_out, CASE WHEN n > 1 THEN CAST(3 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS max_fan_out, CAST(0 AS DOUBLE) AS ambiguity_rate,
  CAST(1 AS DOUBLE) AS source_coverage, round(3 * n / (bytes / 1024.0), 6) AS nodes_per_kb,
  round((least(1.0, (n + 1) / 20.0) + (CASE WHEN n > 1 THEN 3 ELSE 1 END) / 20.0 + least(1.0, (CASE WHEN n > 1 THEN 3 ELSE 1 END) / CAST(3 * n - 1 AS DOUBLE))) / 4, 9) AS complexity
FROM s
""")
def graph_report(spark, sf):
    from glyphflow.sources import cut_lineage

    forest = cut_lineage(parse.parse(_sums(spark, sf), SUMS, "l_orderkey").select("l_orderkey", "nodes", "edges", "source_length"))
    out = graph.report(parse.nodes(forest, "l_orderkey"), parse.edges(forest, "l_orderkey"), forest, "l_orderkey")
    return out.select("l_orderkey", "node_count", "edge_count", "max_depth", F.round("average_fan_out", 9).alias("average_fan_out"), "max_fan_out", "ambiguity_rate", "source_coverage", F.round("nodes_per_kb", 6).alias("nodes_per_kb"), F.round("complexity", 9).alias("complexity"))


@register("graph_type_hist", "SELECT event_id, 100 AS node_type, CAST(5 AS BIGINT) AS n FROM events UNION ALL SELECT event_id, 200, CAST(2 AS BIGINT) FROM events")
def graph_type_hist(spark, sf):
    return graph.type_histogram(parse.nodes(parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props"), "event_id"), "event_id")


@register("graph_hotspots", """
SELECT event_id, 1 AS rank, CAST(0 AS BIGINT) AS source_start, CAST(3 AS BIGINT) AS children FROM events
UNION ALL SELECT event_id, 2, CAST(1 AS BIGINT), CAST(3 AS BIGINT) FROM events
""")
def graph_hotspots(spark, sf):
    from glyphflow.sources import cut_lineage

    forest = cut_lineage(parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props").select("event_id", "nodes", "edges"))
    return graph.hotspots(parse.nodes(forest, "event_id"), parse.edges(forest, "event_id"), id_col="event_id").select("event_id", "rank", "source_start", "children")


@register("graph_bfs_depth", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders),
n AS (SELECT n_nationkey AS node, 'n' AS kind, n_regionkey AS parent FROM nation),
t(doc, node, depth) AS (SELECT r_regionkey, CAST('r' || r_regionkey AS VARCHAR), 0 FROM region
  UNION ALL SELECT t.doc, x.node, t.depth + 1 FROM t JOIN (
    SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer) x ON x.parent = t.node)
SELECT doc AS doc_id, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM t GROUP BY ALL
""")
def graph_bfs_depth(spark, sf):
    """Breadth-first depth over region -> nation -> customer trees."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    links = nation.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("n"), "n_nationkey").alias("child_id"))
    owners = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("doc_id"))
    links = links.unionByName(customer.join(owners, "c_nationkey").select("doc_id", F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.concat(F.lit("c"), "c_custkey").alias("child_id")))
    roots = region.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"))
    nodes = roots.unionByName(links.select("doc_id", F.col("child_id").alias("node_id")))
    return graph.with_depth(nodes, links, roots).groupBy("doc_id", "depth").agg(F.count("*").alias("n"))


@register("select_regex", r"""
SELECT event_id, '"k"' AS node_text, CAST(strpos(props, '"k"') - 1 AS BIGINT) AS source_start FROM events WHERE regexp_matches(props, '"k"')
""")
def select_regex(spark, sf):
    events = texts(spark, sf, "events")
    rows = select.node_text(parse.nodes(parse.parse(events, PROPS, "event_id", "props"), "event_id"), events, "event_id", "props")
    return select.by_regex(rows, '^"k"$').select("event_id", "node_text", "source_start")


@register("select_structural", "SELECT event_id, 'pair' AS rule_name, CAST(1 AS BIGINT) AS source_start, CAST(strlen(props) - 2 AS BIGINT) AS source_length FROM events")
def select_structural(spark, sf):
    rows = parse.nodes(parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props"), "event_id")
    return select.by_rule(rows, "PAIR").select("event_id", "rule_name", "source_start", "source_length")


@register("select_range", "SELECT event_id, CAST(4 AS BIGINT) AS n FROM events")
def select_range(spark, sf):
    # A forest knows its source's length, so the nodes needn't meet the events again.
    forest = parse.parse(texts(spark, sf, "events"), PROPS, "event_id", "props")
    rows = forest.select("event_id", F.col("source_length").alias("len"), F.explode("nodes").alias("node")).select("event_id", "len", "node.*")
    return select.in_range(rows, 1, F.col("len") - 1).groupBy("event_id").agg(F.count("*").alias("n"))


@register("node_at_offset", "SELECT event_id, 2 AS \"offset\", 'STRING' AS rule_name FROM events")
def node_at_offset(spark, sf):
    events = texts(spark, sf, "events")
    rows = parse.nodes(parse.parse(events, PROPS, "event_id", "props"), "event_id").select("event_id", "source_start", "source_length", "rule_name")
    return select.at_offset(rows, events.select("event_id", F.lit(2).alias("offset")), "event_id").select("event_id", "offset", "rule_name")


def _symbols(spark, sf):
    """Declarations made of orders: a priority is declared in its customer's segment of a status."""
    return table(spark, sf, "orders").select(F.lit("shop").alias("project"), F.concat_ws(".", F.col("o_orderstatus"), (F.col("o_custkey") % 50).cast("string")).alias("scope"), F.regexp_extract("o_orderpriority", "[0-9]-?(.*)", 1).alias("name"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


_SYMBOL_SQL = "d AS (SELECT 'shop' AS project, o_orderstatus || '.' || (o_custkey % 50) AS scope, regexp_extract(o_orderpriority, '[0-9]-?(.*)', 1) AS name, o_totalprice AS value, o_orderkey AS seq FROM orders)"


@register("symbols_latest", f"WITH {_SYMBOL_SQL} SELECT scope, name, arg_max(value, seq) AS value, project || '|' || scope || '.' || name AS symbol_ref FROM d GROUP BY project, scope, name")
def symbols_latest(spark, sf):
    return symbols.declare(_symbols(spark, sf), "seq").select("scope", "name", "value", "symbol_ref")


@register("symbol_lookup_hier", f"""
WITH {_SYMBOL_SQL}, s AS (SELECT DISTINCT scope, name FROM d UNION SELECT DISTINCT 'O', name FROM d UNION SELECT 'O', 'ELSEWHERE'),
u AS (SELECT l_orderkey, l_linenumber, upper(l_returnflag) AS f, 'O.' || (l_partkey % 50) || '.' || l_linenumber AS scope, CASE l_suppkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'URGENT' WHEN 2 THEN 'ELSEWHERE' ELSE 'NONE' END AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a.scope IS NOT NULL THEN a.scope WHEN b.scope IS NOT NULL THEN b.scope END AS found_scope
FROM u LEFT JOIN s a ON a.name = u.name AND a.scope = regexp_extract(u.scope, '^(O\\.[0-9]+)', 1) LEFT JOIN s b ON b.name = u.name AND b.scope = 'O'
""".replace("\\\\", "\\"))
def symbol_lookup_hier(spark, sf):
    declared = _symbols(spark, sf)
    everywhere = declared.withColumn("scope", F.lit("O"))
    # One name stands only in the outer scope, and one nowhere.
    outer = spark.range(1).select(F.lit("shop").alias("project"), F.lit("O").alias("scope"), F.lit("ELSEWHERE").alias("name"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("seq"))
    known = symbols.declare(declared.unionByName(everywhere).unionByName(outer), "seq")
    kind = F.col("l_suppkey") % 4
    name = F.when(kind == 0, "HIGH").when(kind == 1, "URGENT").when(kind == 2, "ELSEWHERE").otherwise("NONE")
    uses = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("O."), (F.col("l_partkey") % 50).cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("scope"), name.alias("name"))
    return symbols.lookup(uses, known).select("l_orderkey", "l_linenumber", "found_scope")


_WORD_SQL = r"w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+|[0-9]+')) AS v FROM documents)"


@register("find_usages", f"WITH {_WORD_SQL} SELECT doc_id, count(*) AS n FROM w WHERE v = 'of' GROUP BY doc_id")
def find_usages(spark, sf):
    rows = L.lex(texts(spark, sf, "documents"), KEYWORDS).withColumn("symbol", F.col("value")).withColumn("scope", F.col("doc_id").cast("string"))
    return symbols.usages(rows, "of").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("rename_edits", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[0-9]+|[ \t\r\n]+|[^a-z0-9 \t\r\n]') AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS value, generate_subscripts(ts, 1) AS i FROM d),
p AS (SELECT *, coalesce(sum(strlen(value)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t)
SELECT doc_id, CAST(s AS INTEGER) AS start_pos, 'of' AS old_text, 'from' AS new_text FROM p WHERE value = 'of'
""")
def rename_edits(spark, sf):
    # Of the tokens only those that are renamed come back from Python.
    rows = L.lex(texts(spark, sf, "documents"), KEYWORDS, positions=True, only=["of"]).withColumn("symbol", F.col("value")).withColumn("scope", F.lit(""))
    return symbols.rename_edits(rows, "of", "from").select("doc_id", "start_pos", "old_text", "new_text")


@register("inline_variable", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS new_text FROM orders WHERE o_orderstatus = 'F'")
def inline_variable(spark, sf):
    orders = table(spark, sf, "orders")
    known = orders.select(F.col("o_orderkey").alias("name"), F.round("o_totalprice").cast("long").alias("value"), (F.col("o_orderstatus") == "F").alias("can_inline"))
    return symbols.inline_variable(orders.select("o_orderkey", F.col("o_orderkey").alias("symbol")), known).select("o_orderkey", "new_text")


@register("applicable_operations", "SELECT o_orderkey, 'rename' AS operation FROM orders UNION ALL SELECT o_orderkey, 'extract' FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT o_orderkey, 'inline' FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def applicable_operations(spark, sf):
    places = table(spark, sf, "orders").withColumn("context", F.col("o_orderstatus"))
    known = [symbols.Operation("rename"), symbols.Operation("extract", ("F", "P")), symbols.Operation("inline", ("O",), F.col("o_totalprice") > 1000)]
    return symbols.applicable(places, known).select("o_orderkey", "operation")


BASE = "Grammar: Base\n<WS> ::= /[ \\t\\r\\n]+/ => { skip(); }\n<IDENT> ::= /[a-z]+/\n<NUM> ::= /[0-9]+/\n<expr> ::= <term> ;\n<term> ::= IDENT | NUM ;\n"
OVERLAY = "Grammar: Over\n<IDENT (priority:5)> ::= /x-[a-z]+/\n<META> ::= /\\$[A-Z_][A-Z0-9_]*/\n<term> ::= META ;\n<call> ::= <expr> '(' <missing> ')'\n"


def _tables(spark, text):
    grammar = read_grammar(text, strict=False)
    tokens = spark.createDataFrame([(t.name, t.pattern, t.priority, t.context, i, t.name in grammar.whitespace_tokens()) for i, t in enumerate(grammar.tokens)], "name string, pattern string, priority int, context string, ordinal int, is_whitespace boolean")
    rules = spark.createDataFrame([(p.name, list(p.rhs), p.precedence) for p in grammar.productions], "name string, rhs array<string>, precedence int")
    return tokens, rules


@register("root_rules", "SELECT * FROM (VALUES ('call')) AS t(name)")
def root_rules(spark, sf):
    return R.root_rules(_tables(spark, BASE)[1].unionByName(_tables(spark, OVERLAY)[1]))


@register("undefined_nonterminals", "SELECT * FROM (VALUES ('missing')) AS t(name)")
def undefined_nonterminals(spark, sf):
    (a, b), (c, d) = _tables(spark, BASE), _tables(spark, OVERLAY)
    return R.undefined(b.unionByName(d), a.unionByName(c))


@register("ignorable_ws", "SELECT * FROM (VALUES ('WS')) AS t(name)")
def ignorable_ws(spark, sf):
    return R.ignorable(*_tables(spark, BASE))


@register("literal_rules", "SELECT * FROM (VALUES ('''(''', '''('''), (''')''', ''')''')) AS t(literal, rule)")
def literal_rules(spark, sf):
    tokens, rules = _tables(spark, OVERLAY)
    return R.literal_rules(rules, tokens)


_OVERLAID = {
    "BaseWins": ("('IDENT', '/[a-z]+/', 'base', true)", "('term', 'IDENT', 'base'), ('term', 'NUM', 'base')"),
    "OverlayWins": ("('IDENT', '/x-[a-z]+/', 'overlay', true)", "('term', 'META', 'overlay')"),
    "Additive": ("('IDENT', '/[a-z]+/', 'base', true)", "('term', 'IDENT', 'base'), ('term', 'NUM', 'base'), ('term', 'META', 'overlay')"),
    "PriorityBased": ("('IDENT', '/x-[a-z]+/', 'overlay', true)", "('term', 'META', 'overlay')"),
}
for _policy, (_token, _rules) in _OVERLAID.items():

    def _tokens_of(spark, sf, policy=_policy):
        out = R.overlay_tokens(_tables(spark, BASE)[0], _tables(spark, OVERLAY)[0], policy)
        return out.select("name", "pattern", "origin", "conflict")

    def _rules_of(spark, sf, policy=_policy):
        out = R.overlay_productions(_tables(spark, BASE)[1], _tables(spark, OVERLAY)[1], policy)
        return out.select("name", F.array_join("rhs", " ").alias("rhs"), "origin")

    register(f"overlay_tokens_{_policy}", rf"SELECT * FROM (VALUES {_token}, ('WS', '/[ \t\r\n]+/', 'base', false), ('NUM', '/[0-9]+/', 'base', false), ('META', '/\$[A-Z_][A-Z0-9_]*/', 'overlay', false)) AS t(name, pattern, origin, conflict)")(_tokens_of)
    register(f"overlay_rules_{_policy}", f"SELECT * FROM (VALUES {_rules}, ('expr', 'term', 'base'), ('call', 'expr ''('' missing '')''', 'overlay')) AS t(name, rhs, origin)")(_rules_of)


@register("overlay_conflicts", "SELECT * FROM (VALUES ('production term'), ('token IDENT')) AS t(conflict)")
def overlay_conflicts(spark, sf):
    return spark.createDataFrame([(c.split(":")[0],) for c in compose_text(BASE, OVERLAY)[1]], "conflict string")


_EBNF = {"<a> <b>?": (2, 0), "<a> ( ',' <a> )*": (2, 2), "<a>+": (1, 2), "( <a> | <b> <c> ) <d>?": (4, 0), "<a>? <b>? <c>?": (7, 0), "ε | <a>": (1, 0), "( <a> | <b> )*": (1, 4)}


@register("ebnf_expansion_counts", "SELECT * FROM (VALUES " + ", ".join(f"('{b.replace(chr(39), chr(39) * 2)}', {n}, {h})" for b, (n, h) in _EBNF.items()) + ") AS t(body, alternatives, helpers)")
def ebnf_expansion_counts(spark, sf):
    rows = []
    for body in _EBNF:
        n = Normalizer("owner", set())
        rows.append((body, len([a for a in n.alternatives(body) if a]), len(set(n.helpers))))
    return spark.createDataFrame(rows, "body string, alternatives int, helpers int")


@register("grammar_inheritance", "SELECT * FROM (VALUES ('c', 'b', 1), ('c', 'a', 2), ('b', 'a', 1), ('x', 'y', 1), ('y', 'x', 1), ('x', 'x', 2), ('y', 'y', 2)) AS t(name, ancestor, depth)")
def grammar_inheritance(spark, sf):
    return R.ancestors(spark, spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "name string, inherits string"))


SESSION_RULES = [compile_rule("word", "/[a-z]+/", 0, 0), compile_rule("number", "/[0-9]+/", 0, 1), compile_rule("mark", "/[^a-z0-9]/", 0, 2)]


def _edits(spark, sf):
    """Each user's events as appended edits: version 0 opens the session."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = texts(spark, sf, "events").select("user_id", "event_id", F.concat("event_type", F.lit(";")).alias("t"), (F.row_number().over(w) - 1).alias("version"))
    length = F.sum(F.length("t")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(F.col("user_id").cast("string").alias("session_id"), "version", F.coalesce(length, F.lit(0)).cast("int").alias("offset"), F.lit(0).alias("delete_length"), F.col("t").alias("insert_text"))


@register("session_fold_text", "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(count(*) - 1 AS INTEGER) AS version, string_agg(event_type || ';', '' ORDER BY event_id) AS text, CAST(2 * count(*) AS INTEGER) AS n_tokens FROM events GROUP BY user_id")
def session_fold_text(spark, sf):
    # Only the marks beyond words and numbers count as tokens of their own, so an event is a word and a semicolon.
    rows = session.fold(_edits(spark, sf), [*SESSION_RULES[:2], compile_rule("mark", "/[^a-z0-9]/", 0, 2)])
    return rows.groupBy("session_id").agg(F.max(F.struct("version", "text", "n_tokens")).alias("x")).select("session_id", "x.version", "x.text", "x.n_tokens")


@register("session_metrics", "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS version, CAST(2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS n_tokens, true AS consumed_all, -1 AS unmatched_offset FROM events")
def session_metrics(spark, sf):
    return session.fold(_edits(spark, sf), SESSION_RULES).select("session_id", "version", "n_tokens", "consumed_all", "unmatched_offset")


@register("session_reuse", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT session_id, CAST(sum(CASE WHEN k = 1 THEN 2 ELSE 3 END) AS BIGINT) AS relexed, CAST(sum(CASE WHEN k = 1 THEN 0 ELSE 2 * (k - 1) - 1 END) AS BIGINT) AS reused FROM e GROUP BY session_id
""")
def session_reuse(spark, sf):
    return session.fold(_edits(spark, sf), SESSION_RULES).groupBy("session_id").agg(F.sum("relexed_tokens").alias("relexed"), F.sum("reused_tokens").alias("reused"))


@register("session_parse", """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(k - 1 AS INTEGER) AS version, CAST(2 * k - 1 AS INTEGER) AS n_tokens, true AS success_full,
       CAST(1 AS INTEGER) AS n_parses, CAST(3 * k AS INTEGER) AS n_nodes, CAST(greatest(2 * k - 4, 0) AS INTEGER) AS resumed_token
FROM e
""")
def session_parse(spark, sf):
    """Each user's events as a sum that grows by one number an event, parsed at every version.

    By the left-recursive reading an edit at the end leaves all nodes before it, so no version's parse begins anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("version"))
    first = F.col("version") == 0
    edits = rows.select(F.col("user_id").alias("session_id"), "version", F.greatest(2 * F.col("version") - 1, F.lit(0)).alias("offset"), F.lit(0).alias("delete_length"), F.when(first, "1").otherwise("+1").alias("insert_text"))
    return session.fold(edits, LEFT_SUMS.lexer_rules(), LEFT_SUMS).select("session_id", "version", "n_tokens", "success_full", "n_parses", "n_nodes", "resumed_token")



def _sum_sql(weights, columns):
    return "1 / (1 + exp(-(" + " + ".join(f"{w} * {c}" for w, c in zip(weights, columns, strict=True)) + ")))"


@register("rule_prior_score", """
WITH r AS (SELECT * FROM (VALUES ('/[0-9]+/', false, ''), ('/[a-zA-Z][a-zA-Z0-9]*/', false, ''), ('/[ \\t]+/', true, ''), ('''if''', false, 'code'), ('x', false, '')) AS t(pattern, is_skippable, context)),
b AS (SELECT DISTINCT unicode(event_type) AS first_byte FROM events UNION SELECT 48 UNION SELECT 32 UNION SELECT 200),
f AS (SELECT *, pattern LIKE '/%/' AS regex, replace(pattern, '''', '') AS core FROM r, b)
SELECT pattern, CAST(first_byte AS INTEGER) AS first_byte, round(1 / (1 + exp(-(-0.3
  + 2.0 * CAST(NOT regex AND unicode(core) = first_byte AS INTEGER) + 1.5 * CAST(regex AND first_byte BETWEEN 48 AND 57 AND contains(pattern, '[0-9]') AS INTEGER)
  + 1.5 * CAST(regex AND (first_byte BETWEEN 65 AND 90 OR first_byte BETWEEN 97 AND 122) AND contains(pattern, '[a-zA-Z]') AS INTEGER)
  + 1.2 * CAST(regex AND first_byte IN (32, 9, 10, 13) AND contains(pattern, '[ \\t') AS INTEGER) + 0.1 * CAST(regex AS INTEGER) + 0.2 * CAST(is_skippable AS INTEGER)
  - 0.2 * CAST(context <> '' AS INTEGER) - 0.5 * CAST(NOT regex AND unicode(core) <> first_byte AS INTEGER) + 0.2 * CAST(first_byte >= 128 AS INTEGER)))), 9) AS probability
FROM f
""".replace("\\\\", "\\"))
def rule_prior_score(spark, sf):
    rules = spark.createDataFrame([("/[0-9]+/", False, ""), ("/[a-zA-Z][a-zA-Z0-9]*/", False, ""), ("/[ \\t]+/", True, ""), ("'if'", False, "code"), ("x", False, "")], "pattern string, is_skippable boolean, context string")
    bytes_ = texts(spark, sf, "events").select(F.ascii("event_type").alias("first_byte")).distinct().unionByName(spark.createDataFrame([(48,), (32,), (200,)], "first_byte int")).distinct()
    crossed = bytes_.crossJoin(F.broadcast(rules))  # five rules
    return features.score_rules(crossed).select("pattern", "first_byte", F.round("probability", 9).alias("probability"))


@register("path_doom_score", """
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-3.0 + 2.0 * greatest(0.0, least(1.0, 1 - l_discount / 0.1)) + 3.0 * greatest(0.0, least(1.0, (50 - l_quantity) / 50.0))
  + 1.5 * CAST(l_suppkey % 5 - 1 < 0 AS INTEGER) + 1.0 * CAST(l_discount < 0.5 AS INTEGER) + 0.1 * (l_linenumber / 8.0)))), 9) AS probability FROM lineitem
""")
def path_doom_score(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"), F.col("l_quantity").alias("position"), (F.col("l_suppkey") % 5 - 1).alias("last_start"), F.col("l_linenumber").alias("number"), F.lit(0.1).alias("best_score"), F.lit(50.0).alias("best_position"), F.lit(7).alias("tokens"))
    return features.score_paths(rows).select("l_orderkey", "l_linenumber", F.round("probability", 9).alias("probability"))


_SCORED = "s AS (SELECT event_type, (event_id * 37 % 101) / 101.0 AS p, CAST((event_id * 53 % 97) < 30 OR value > 20 AS INTEGER) AS y FROM events)"


@register("label_metrics", f"""
WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS k FROM s)
SELECT event_type, count(*) AS n, round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, p)) ELSE ln(1 - p) END), 9) AS log_loss, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 9) AS accuracy,
  round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auc
FROM r GROUP BY event_type
""")
def label_metrics(spark, sf):
    p = (F.col("event_id") * 37 % 101) / 101.0
    y = ((F.col("event_id") * 53 % 97 < 30) | (F.col("value") > 20)).cast("int")
    rows = texts(spark, sf, "events").select("event_type", p.alias("probability"), y.alias("label"))
    out = train.evaluate(rows, ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("log_loss", "accuracy", "auc")])


@register("train_path_model")
def train_path_model(spark, sf):
    """A model of returned lines, trained on four fifths and judged on the rest."""
    x = F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    rows = table(spark, sf, "lineitem").select("l_orderkey", x.alias("features"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    learn, held = train.hold_out(rows, "l_orderkey")
    w = train.train(learn)
    scored = held.withColumn("probability", 1 / (1 + F.exp(-train._z(w, len(w)))))
    return train.evaluate(scored).select("n", *[F.round(c, 4).alias(c) for c in ("log_loss", "accuracy", "auc")])


@register("wasted_attempts", "SELECT count(*) AS n, true AS fewer FROM events")
def wasted_attempts(spark, sf):
    """Ordering rules by the model changes the attempts that fail first, and no token."""
    events = texts(spark, sf, "events")
    off = L.lex_status(events, PROPS, "event_id", "props", "greedy")
    on = L.lex_status(events, PROPS, "event_id", "props", "greedy", prioritizer=features.rule_probability)
    both = off.select("event_id", "wasted", "n_tokens").join(on.select("event_id", F.col("wasted").alias("w"), F.col("n_tokens").alias("t")), "event_id")
    return both.agg(F.count("*").alias("n"), F.bool_and((F.col("w") <= F.col("wasted")) & (F.col("t") == F.col("n_tokens"))).alias("fewer"))


@register("latency_percentiles", "SELECT event_type, count(value) AS n, min(value) AS least, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return stats.percentiles(texts(spark, sf, "events"), "value", ["event_type"])


@register("latency_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_nearest_rank(spark, sf):
    return stats.nearest_rank(texts(spark, sf, "events"), "value", ["event_type"])


@register("scaling_fit", "SELECT lang, round(regr_slope(strlen(text), n_chars), 9) AS slope, round(regr_intercept(strlen(text), n_chars), 4) AS intercept, round(regr_r2(strlen(text), n_chars), 9) AS r2 FROM documents GROUP BY lang")
def scaling_fit(spark, sf):
    rows = texts(spark, sf, "documents").select("lang", F.octet_length("text").alias("y"), F.col("n_chars").alias("x"))
    out = stats.linear_fit(rows, "y", "x", ["lang"])
    return out.select("lang", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@register("loglog_exponent", "SELECT lang, round(regr_slope(ln(strlen(text)), ln(n_chars)), 9) AS exponent FROM documents WHERE n_chars > 0 GROUP BY lang")
def loglog_exponent(spark, sf):
    rows = texts(spark, sf, "documents").select("lang", F.octet_length("text").alias("y"), F.col("n_chars").alias("x"))
    return stats.scaling_exponent(rows, "y", "x", ["lang"]).select("lang", F.round("exponent", 9).alias("exponent"))


@register("pearson", "SELECT event_type, round(corr(event_id, value), 9) AS r FROM events GROUP BY event_type")
def pearson(spark, sf):
    return stats.pearson(texts(spark, sf, "events"), "event_id", "value", ["event_type"]).select("event_type", F.round("r", 9).alias("r"))


CASES = [
    ("char-class", "[aeiou]{2}", "ae123", "ae"), ("char-class", "[^0-9]+", "ab1", "ab"), ("dot", "a.c", "abc", "abc"), ("dot", "a.c", "a\nc", None),
    ("quantifier-bounded", "a{2,4}", "aaaaaa", "aaaa"), ("quantifier-lazy", "a+?", "aaa", "a"), ("quantifier-possessive", r"\d++\.\d++", "3.14", "3.14"),
    ("alternation-order", "foo|foobar", "foobar", "foobar"), ("group", "((a|b)c)+", "acbcx", "acbc"), ("inline-modifier", "(?i)abc", "AbC", "AbC"),
    ("quoted-literal", r"\Qfoo.bar\E", "foo.bar baz", "foo.bar"), ("property", r"\p{Lu}\p{Ll}+", "Été", "Été"), ("escape", r"\x{41}\x42", "ABC", "AB"),
    ("anchor", "^abc", "abc", None), ("lookaround", "abc(?=def)", "abcdef", None), ("backreference", r"(a)\1", "aa", None), ("named-group", r"(?<word>\w+)", "a", None),
]


@register("conformance_matrix", "SELECT feature, count(*) AS n, count(*) AS n_passed, CAST(1 AS DOUBLE) AS rate FROM (VALUES " + ", ".join(f"('{c[0]}')" for c in CASES) + ") AS t(feature) GROUP BY feature")
def conformance_matrix(spark, sf):
    rows = []
    for feature, pattern, text, want in CASES:
        end = compile_rule("r", f"/{pattern}/").matcher()(text, 0)
        rows.append((feature, (text[:end] if end >= 0 else None) == want))
    return stats.pass_rate(spark.createDataFrame(rows, "feature string, passed boolean"), "feature")


@register("ascii_share", "SELECT lang, round(avg(CAST(strlen(text) = length(text) AS INTEGER)), 9) AS share FROM documents GROUP BY lang")
def ascii_share(spark, sf):
    return texts(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(is_ascii(F.col("text")).cast("int")), 9).alias("share"))
