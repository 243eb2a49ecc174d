"""Edit sessions: incremental equals cold, batch equals stream."""

import random

import pytest

from glyphflow.glr import Parser
from glyphflow.grammar import read_grammar
from glyphflow.plans.queries_parse import SUMS
from glyphflow.rules import compile_rule
from glyphflow.streaming import session

RULES = [compile_rule("word", "/[a-z]+/", 0, 0), compile_rule("number", "/[0-9]+/", 0, 1), compile_rule("mark", "/[;.]/", 0, 2), compile_rule("ws", r"/[ \n]+/", 0, 3, skippable=True)]
LEXER = session._Characters(RULES)


def values(s):
    return [(t.value, t.start, t.end, t.type) for t in s.tokens]


@pytest.mark.parametrize(("start", "edit", "text", "tokens"), [("123x7", (3, 0, "4"), "1234x7", ["1234", "x", "7"]), ("abc;123;def;ghi", (4, 3, "9"), "abc;9;def;ghi", ["abc", ";", "9", ";", "def", ";", "ghi"]), ("abc;123", (7, 0, ";def"), "abc;123;def", ["abc", ";", "123", ";", "def"]), ("abc\ndef\nghi", (4, 0, "X"), "abc\nXdef\nghi", ["abc"])])
def test_edits(start, edit, text, tokens):
    s = session.apply_edit(LEXER, session.open_session(LEXER, start), *edit)
    assert s.text == text and [t.value for t in s.tokens] == tokens and s.version == 1


def test_incremental_equals_cold():
    rng = random.Random(2)
    s = session.open_session(LEXER, "")
    for _ in range(600):
        at = rng.randint(0, len(s.text))
        gone = rng.randint(0, min(6, len(s.text) - at))
        put = "".join(rng.choice(["a", "bc", "1", "23", ";", " ", "\n", "@"] if rng.random() < 0.3 else ["word ", "12;", "x"]) for _ in range(rng.randint(0, 5)))
        s = session.apply_edit(LEXER, s, at, gone, put)
        cold = session.open_session(LEXER, s.text)
        assert values(s) == values(cold) and s.unmatched == cold.unmatched
    with pytest.raises(ValueError, match="outside"):
        session.apply_edit(LEXER, s, len(s.text), 1, "")


def test_far_edits_reuse_the_tail():
    s = session.open_session(LEXER, "word 12;" * 500)
    s = session.apply_edit(LEXER, s, 16, 0, "z")
    assert s.metrics["relexed_tokens"] < 20 and s.metrics["reused_tokens"] > 1400


EDITS = [("a", 0, 0, 0, "abc;1"), ("a", 2, 0, 1, ""), ("a", 1, 5, 0, "2;d"), ("a", 3, 99, 1, "no"), ("b", 0, 0, 0, "x y"), ("b", 5, 0, 0, "never"), ("b", 0, 0, 0, "again"), ("c", 0, 0, 0, None)]
DDL = "session_id string, version int, offset int, delete_length int, insert_text string"


def test_fold_orders_waits_and_leaves_out(spark):
    got = {(r["session_id"], r["version"]): (r["text"], r["n_tokens"]) for r in session.fold(spark.createDataFrame(EDITS, DDL), RULES).collect()}
    assert got == {("a", 0): ("abc;1", 3), ("a", 1): ("abc;12;d", 5), ("a", 2): ("bc;12;d", 5), ("a", 3): ("bc;12;d", 5), ("b", 0): ("x y", 2), ("c", 0): ("", 0)}
    assert session.fold(spark.createDataFrame([], DDL), RULES).count() == 0


def test_stream_equals_fold(spark, tmp_path):
    frame = spark.createDataFrame(EDITS, DDL)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = session.stream(rows, RULES).writeStream.format("memory").queryName("edits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    columns = ["session_id", "version", "text", "n_tokens", "relexed_tokens", "reused_tokens"]
    assert sorted(map(tuple, spark.table("edits").select(columns).collect())) == sorted(map(tuple, session.fold(frame, RULES).select(columns).collect()))


def test_checkpoints_thin_out():
    c = session.ParseCheckpoints(8)
    for b in range(0, 40, 2):
        c.store(b, f"s{b}")
    assert len(c.at) <= 8 and c.nearest(39)[0] == 38 and c.nearest(-1) is None
    c.invalidate_from(20)
    assert max(c.at) < 20 and c.nearest(100) == (max(c.at), f"s{max(c.at)}")


def test_impact():
    s = session.open_session(LEXER, "ab 12")
    assert session.edit_impact(s.tokens, 2, 0, "xy") == session.Impact(0, 0, 2)


TWO_WAYS = read_grammar(r"""
Grammar: TwoWays
<NUM> ::= /[0-9]+/
<PLUS> ::= '+'
<start> ::= <expr>
<expr> ::= <expr> <PLUS> <expr> | <NUM>
""")


def shape(r):
    return sorted((n.type, n.name, n.value or "", n.start, n.length, d) for n, d in r.nodes), r.parses, r.success_full, r.success_prefix, r.failed_at, len(r.packed), len(r.edges), [(t.value, t.start) for t in r.resolved]


@pytest.mark.parametrize(("grammar", "prefixes", "seed"), [(SUMS, False, 1), (SUMS, True, 2), (TWO_WAYS, False, 3)])
def test_resumed_parses_equal_cold_ones(grammar, prefixes, seed):
    rng = random.Random(seed)
    lexer, parser = session._Characters(grammar.lexer_rules()), Parser(grammar, prefixes=prefixes)
    most = 9 if grammar is TWO_WAYS else 60
    s, parses, resumed, failed = session.open_session(lexer, "1"), session.SessionParser(parser), 0, 0
    for step in range(200):
        if step % 25 == 24 or len(s.text) > 4 * most:
            # A whole sum again, after edits that mostly left none.
            put = "+".join(str(rng.randint(1, 99)) for _ in range(most // 3))
            edit = (0, len(s.text), put)
        elif rng.random() < 0.8:
            # Behind a digit a further summand leaves a sum a sum.
            digits = [i + 1 for i, c in enumerate(s.text) if c.isdigit()] or [0]
            edit = (rng.choice(digits), 0, rng.choice(["+12", "+3", "5"]))
        else:
            at = rng.randint(0, len(s.text))
            edit = (at, rng.randint(0, min(3, len(s.text) - at)), rng.choice(["", "+", "7+", "@"]))
        s = session.apply_edit(lexer, s, *edit)
        parses.edited(s.metrics["first_token"])
        if rng.random() < 0.3:
            continue  # edits gather until the next parse
        warm, cold = parses.parse(s.tokens, len(s.text)), Parser(grammar, prefixes=prefixes)(s.tokens, len(s.text))
        assert shape(warm) == shape(cold), s.text
        resumed += parses.resumed > 0
        failed += not warm.success_full
    assert resumed > 20 and failed > 5


def test_an_edit_at_the_end_takes_up_near_it():
    lexer, parses = session._Characters(SUMS.lexer_rules()), session.SessionParser(Parser(SUMS))
    s = session.open_session(lexer, "+".join(["12"] * 400))
    assert parses.parse(s.tokens, len(s.text)).steps == 799
    s = session.apply_edit(lexer, s, len(s.text), 0, "+3")
    parses.edited(s.metrics["first_token"])
    assert parses.parse(s.tokens, len(s.text)).steps <= 4 and parses.resumed >= 797
    # Parses that write much more than they keep begin anew.
    begun = []
    for _ in range(12):
        s = session.apply_edit(lexer, s, 0, 1, "2")
        parses.edited(s.metrics["first_token"])
        parses.parse(s.tokens, len(s.text))
        begun.append(any(r.written == 0 for r in parses.readings.values() if r is parses.readings[True]))
    assert any(begun)


def test_fold_with_a_grammar(spark):
    rows = [("a", 0, 0, 0, "1+2"), ("a", 1, 3, 0, "+3"), ("a", 2, 1, 1, "++"), ("a", 3, 99, 0, "no"), ("a", 4, 1, 1, ""), ("b", 0, 0, 0, None)]
    got = {(r["session_id"], r["version"]): (r["text"], r["success_full"], r["n_parses"]) for r in session.fold(spark.createDataFrame(rows, DDL), SUMS.lexer_rules(), SUMS).collect()}
    assert got == {("a", 0): ("1+2", True, 1), ("a", 1): ("1+2+3", True, 1), ("a", 2): ("1++2+3", False, got["a", 2][2]), ("a", 3): ("1++2+3", False, got["a", 2][2]), ("a", 4): ("1+2+3", True, 1), ("b", 0): ("", False, 0)}
