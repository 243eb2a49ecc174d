"""Patterns and the two lexers."""

import random
import re

import pytest

from glyphflow.functions.unicode_tables import LAST, inverted, matches_property, merged, normalize_name, property_ranges
from glyphflow.grammar import read_grammar
from glyphflow.lexer import Lexer, Positions, split_escapes
from glyphflow.ml.features import rule_probability
from glyphflow.plans.lexing import native_lexer
from glyphflow.rules import MAX_REPEAT, compile_rule, validate_pattern

MATCHES = [
    ("/[0-9]+/", "12a", "12", "DigitRun"),
    ("/[a-zA-Z][a-zA-Z0-9]*/", "a1_", "a1", "IdentifierRun"),
    (r"/[ \t\r\n]+/", " \n\tx", " \n\t", "WhitespaceRun"),
    (r"/\$[A-Z_][A-Z0-9_]*/", "$A_1b", "$A_1", "MetavariableRun"),
    ("'if'", "ifx", "if", "Literal"),
    ('"if"', "i", None, "Literal"),
    ("plus", "plus", "plus", "Literal"),
    ("'(?i)IF'", "iF", "iF", "Literal"),
    (r"/\Qa.b\E+/", "a.ba.bc", "a.ba.b", "QuotedLiteral"),
    (r"/\Qa.b/", "a.b", "a.b", "QuotedLiteral"),
    (r"/\p{L}+/", "été9", "été", "UnicodeProperty"),
    (r"/\P{L}/", "9", "9", "UnicodeProperty"),
    ("/[a-z]+[0-9]/", "abc1", "abc1", "ClassSequence"),
    ("/[a-z]+[a-z]/", "abc", None, "ClassSequence"),
    ("/[a-z]*b/", "aab", None, "ClassSequence"),
    ("/a{2,4}/", "aaaaaa", "aaaa", "ClassSequence"),
    ("/a{2,}/", "aaa", "aaa", "ClassSequence"),
    ("/a{3}/", "aa", None, "ClassSequence"),
    ("/a+?/", "aaa", "a", "ClassSequence"),
    ("/a{2,5}?/", "aaa", "aa", "ClassSequence"),
    ("/[]a]+/", "]a]b", "]a]", "ClassSequence"),
    (r"/[\w-]+/", "a-b c", "a-b", "ClassSequence"),
    ("/[a-]+/", "a-b", "a-", "ClassSequence"),
    (r"/[^\d]/", "a", "a", "ClassSequence"),
    (r"/\x41\x{42}\t/", "AB\t", "AB\t", "ClassSequence"),
    (r"/\h+/", " \t\n", " \t", "ClassSequence"),
    ("/a.c/", "a\nc", None, "ClassSequence"),
    ("/a.c/", "a\rc", "a\rc", "ClassSequence"),
    (r"/\b/", "b", "b", "ClassSequence"),
    ("/(?i)abc/", "AbC", "AbC", "ClassSequence"),
    ("/(?x) a b #c/", "ab", "ab", "ClassSequence"),
    ("/a(?#note)b/", "ab", "ab", "ClassSequence"),
    ("/foo|foobar/", "foobar", "foobar", "RegexNfa"),
    ("/((a|b)c)+/", "acbcx", "acbc", "RegexNfa"),
    ("/(?>ab)?c/", "abc", "abc", "RegexNfa"),
    ("/(a*)*b/", "aaab", "aaab", "RegexNfa"),
    ("/(a|é){2,3}/", "éaéa", "éaé", "RegexNfa"),
]


@pytest.mark.parametrize(("pattern", "text", "want", "kind"), MATCHES)
def test_matches(pattern, text, want, kind):
    rule = compile_rule("r", pattern)
    end = rule.matcher()(text, 0)
    assert (text[:end] if end >= 0 else None, rule.kind) == (want, kind)


@pytest.mark.parametrize("pattern", ["/^a/", "/a$/", "/a(?=b)/", "/(?<!a)b/", r"/(a)\1/", r"/(?<n>a)/", "/(?i:a)/", r"/(\ba)/", "/(a/", "/a)/", "/[a/", "/*a/", r"/\p{Nope}/", "/[z-a]/", "/a{3,2}/", "/x\\/", f"/(a){{{MAX_REPEAT + 1}}}/", r"/\x{110000}/", "''", "/a{0}/"])
def test_rejected(pattern):
    assert validate_pattern(pattern)
    assert compile_rule("r", pattern).matcher()("aaa", 0) == -1


def test_empty_matches_are_none():
    assert compile_rule("r", "/a*/").matcher()("b", 0) == -1
    assert compile_rule("r", "/(a|b)*/").matcher()("c", 0) == -1


def test_sets_of_code_points():
    assert merged([(5, 9), (1, 4), (20, 21)]) == ((1, 9), (20, 21))
    assert inverted(((0, 9), (11, LAST))) == ((10, 10),)
    for name, inside, outside in (("Lu", "É", "é"), ("Greek", "α", "a"), ("InBasic_Latin", "a", "é"), ("white-space", "\u00a0", "a"), ("Letter", "ß", "1"), ("Emoji", "😀", "a"), ("IDS_Binary_Operator", None, "a")):
        assert inside is None or matches_property(ord(inside), name)
        assert not matches_property(ord(outside), name)
    assert property_ranges("Nope") is None and normalize_name(" ") is None and not matches_property(-1, "L")
    assert normalize_name("Old Turkic", ("Old_Turkic",)) == ("Old_Turkic", "named")


def types(rules, text, **how):
    return [(t.type, t.value) for t in Lexer(rules, **how).greedy(text).tokens]


WS = compile_rule("ws", r"/[ \t\r\n]+/", -9, 9, skippable=True)


def rules(*specs):
    made = [compile_rule(n, p, priority, i) for i, (n, p, priority) in enumerate(specs)]
    return sorted([*made, WS], key=lambda r: (-r.priority, r.ordinal))


def test_longest_match_and_ties():
    stems = rules(("noun", "/[a-z]+/", 5), ("adjective", "/[a-z]+/", 4), ("verb", "/[a-z]+/", 3))
    assert types(stems, "hej med dig") == [("noun", "hej"), ("noun", "med"), ("noun", "dig")]
    ab = rules(("AB", "'ab'", 100), ("IDENT", "/[a-z]+/", 0))
    assert types(ab, "abcd") == [("IDENT", "abcd")]
    assert types(ab, "ab x") == [("AB", "ab"), ("IDENT", "x")]
    kw = rules(("KW", "'if'", 10), ("IDENT", "/[a-z]+/", 1))
    assert types(kw, "if ifx") == [("KW", "if"), ("IDENT", "ifx")]


@pytest.mark.parametrize(("budget", "most", "completed"), [(8, 8, True), (1, 1, True), (0, None, True)])
def test_path_budget(budget, most, completed):
    overlap = rules(("word", "/[a-z]+/", 5), ("letter", "/[a-z]/", 4), ("two", "/[a-z][a-z]?/", 3))
    found = Lexer(overlap, budget).explore("abcdefgh ijklmnop")
    assert found.completed is completed
    assert found.most_active <= most if most else found.most_active > 64


def test_positions_and_restart():
    lexer = Lexer(rules(("n", "/[0-9]+/", 0)))
    where = Positions("12\n345\n6")
    for _ in range(2):
        tokens = lexer.greedy("12\n345\n6").tokens
        assert [(*where.line_column(t.start), where.line_column(t.start)[1] + t.end - t.start) for t in tokens] == [(1, 1, 3), (2, 1, 4), (3, 1, 2)]
    assert Positions("é\nab").line_column(3) == (2, 1) and Positions("éa").char(2) == 1


def test_unmatched_and_empty():
    lexer = Lexer(rules(("n", "/[0-9]+/", 0)))
    assert (lexer.greedy("12 é").completed, lexer.greedy("12 é").unmatched) == (False, 3)
    assert lexer.explore("1 @").unmatched == 2 and not lexer.explore("1 @").completed
    assert lexer.greedy("").completed and lexer.explore("").completed


def test_context_rules_need_their_context():
    r = [compile_rule("a", "'a'", 0, 0, context="inner"), compile_rule("b", "/[a-z]/", 0, 1)]
    assert types(r, "a") == [("b", "a")]
    assert types(r, "a", contexts=("default", "inner")) == [("a", "a")]


def test_actions_retype_and_escapes_split():
    assert types([compile_rule("PLUS", "'+'", action='return("ADD");')], "+") == [("ADD", "+")]
    assert split_escapes(r"a\x{41}\x{1F}") == [("HEX_ESCAPE", "41"), ("HEX_ESCAPE", "1F")] and split_escapes(r"\x41") == []


def test_a_learned_order_changes_no_token():
    grammar = read_grammar("<A> ::= 'if'\n<B> ::= /[a-z]+/\n<C> ::= /[0-9]+/")
    text = "if ifx 12 x9 if"
    plain, ordered = (Lexer(grammar.lexer_rules(), prioritizer=p) for p in (None, rule_probability))
    assert plain.greedy(text).tokens == ordered.greedy(text).tokens and plain.explore(text).tokens == ordered.explore(text).tokens


CHOICES = [
    ([("THE", "'the'", 9), ("TH", "'th'", 9), ("W", "/[a-z]+/", 0), ("N", "/[0-9]+/", 0)], True),
    ([("W", "/[a-z]+/", 5), ("THE", "'the'", 0)], True),
    ([("A", "/[a-z]+/", 0), ("B", "/[a-z0-9]+/", 0)], False),
    ([("A", "/a|ab/", 0)], False),
    ([("A", "/[a-z]+/", 0), ("A2", "/[a-z]+/", 0), ("P", "'+'", 0), ("PP", "'++'", 0)], True),
    ([("A", "/[a-z][0-9]/", 0), ("B", "'a1'", 0)], False),
]


@pytest.mark.parametrize(("specs", "possible"), CHOICES)
def test_native_plan_agrees_with_the_general_lexer(specs, possible):
    made = rules(*specs)
    plan = native_lexer(made)
    assert (plan is not None) is possible
    if plan is None:
        return
    rng = random.Random(1)
    python = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", plan.pattern))
    for _ in range(500):
        text = "".join(rng.choice(["the", "th", "e", "x", "1", " ", "+", "@", "é"]) for _ in range(rng.randint(0, 12)))
        lexed = Lexer(made).greedy(text)
        consumed = text if lexed.completed else text.encode()[: lexed.unmatched].decode()
        skip = [m for m in python.findall(consumed) if not m.isspace()]
        assert skip == [t.value for t in lexed.tokens]
