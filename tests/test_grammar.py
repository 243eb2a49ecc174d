"""Grammar files, EBNF, overlays, inheritance."""

import pytest

from glyphflow.grammar import GrammarError, TokenRule, read_grammar, read_grammar_file
from glyphflow.grammar.compose import compose, compose_text, with_pattern_tokens
from glyphflow.grammar.ebnf import EbnfError, Normalizer
from glyphflow.grammar.model import Grammar, Production

RECIPE = """
Grammar: Recipe
<step> ::= /[a-z]+/
<minutes> ::= /[0-9]+/
<then> ::= ';'
<recipe> ::= <timed> ( ';' <timed> )*
<timed> ::= <step> <minutes>?
<served> ::= <step> ( <minutes> <step> | <then> ) <minutes>+
"""


def rhs(grammar, name):
    return [p.rhs for p in grammar.materialized().productions if p.name == name]


def test_quantifiers_and_groups_of_a_recipe():
    g = read_grammar(RECIPE)
    assert rhs(g, "timed") == [("step", "minutes"), ("step",)]
    assert rhs(g, "recipe") == [("timed", "recipe__rep1"), ("timed",)]
    assert rhs(g, "recipe__rep1") == [("then", "timed", "recipe__rep1"), ("then", "timed")]
    assert rhs(g, "served") == [("step", "minutes", "step", "served__rep1"), ("step", "then", "served__rep1")]
    assert rhs(g, "served__rep1") == [("minutes", "served__rep1"), ("minutes",)]


def test_lines_that_only_look_like_levels_or_projections_are_left_alone():
    g = read_grammar(
        "<ID> ::= /[a-z]+/\nPrecedence: {\n  Level: { operators: [\"+\"], associativity: \"left\" }\n  Level3: { operators: [\"[\", ']', ,^], associativity: right }\n"
        "  Level4: { operators: [], associativity: \"left\" }\n}\n@context(a) call => { x }\n@context(f(x)) @projection((ID ID)) twice => { if (a) { b(); } }\n@context(z) @projection(ID) 9x => { n }\n"
    )
    assert g.precedence == {"[": 3, "]": 3, "^": 3} and set(g.associativity.values()) == {"right"}
    assert list(g.projections) == [("twice", "f(x)")] and g.projection("twice", "f(x)").code == "if (a) { b(); }"
    assert g.projection("twice", "f(x)").pattern == "(ID ID)"


def test_files_are_read_by_their_mark_and_once(tmp_path):
    path = tmp_path / "a.grammar"
    path.write_bytes(b"\xff\xfe" + "Grammar: Ä\n<p> ::= <nope>".encode("utf-16-le"))
    first = read_grammar_file(str(path))
    assert first.name == "Ä" and first.notes
    first.notes.clear()
    assert read_grammar_file(str(path)).notes
    with pytest.raises(GrammarError, match="GR3003"):
        read_grammar_file(str(path), strict=True)
    path.write_text("Grammar: B\nInherits: base")
    assert read_grammar_file(str(path), {"base": "<X> ::= 'x'"}).tokens[0].name == "X"


def test_annotations_comments_and_blocks():
    g = read_grammar(
        "Grammar: G\nTokenSplitter: Space\nFormatType: EBNF\n# a comment\n<WS> ::= /[ \\t]+/ => { skip(); }\n<ID (inner, priority:7)> ::= /[a-z]+/;\n"
        "<SLASH> ::= '/'\n@DIALECT[test]\n<p> ::= <ID> '+' <ID>\n   # inside\n   | <ID> => { $1 }\n\nPrecedence: {\n  Level2: { operators: [\"*\", \"/\"], associativity: \"left\" }\n}\n"
        "@context(fn) @projection(ID SLASH) call => { hit(); }\n"
    )
    assert (g.name, g.token_splitter, g.format_type) == ("G", "Space", "EBNF")
    assert [(t.name, t.context, t.priority, t.skippable) for t in g.tokens] == [("WS", "", 0, True), ("ID", "inner", 7, False), ("SLASH", "", 0, False)]
    assert [p.rhs for p in g.productions] == [("ID", "'+'", "ID"), ("ID",)] and g.productions[1].action == "$1"
    assert g.precedence == {"*": 2, "/": 2} and g.associativity["*"] == "left"
    assert g.projection("call", "fn").pattern == "ID SLASH" and g.projection("call", "x") is None
    assert g.contexts == ["inner"] and g.ignorable() == {"WS"} and g.root_rules() == {"p"}


def test_literals_become_rules_once():
    g = read_grammar("<PLUS> ::= '+'\n<N> ::= /[0-9]+/\n<e> ::= <N> '+' <e> | <N> '-' /x+/")
    ready = g.materialized()
    assert [t.name for t in ready.tokens] == ["PLUS", "N", "'-'", "/x+/"]
    assert ready.productions[0].rhs == ("N", "PLUS", "e")
    names = [r.name for r in g.lexer_rules()]
    assert names[-2:] == ["__default_ws", "__default_comment"]


def test_whitespace_tokens_are_optional_in_productions():
    g = read_grammar("<nl> ::= /\\n/\n<w> ::= /[a-z]+/\n<line> ::= <w> <nl>")
    assert rhs(g, "line") == [("w", "nl"), ("w",)]


def test_strict_and_notes():
    text = "<a> ::= <nope> 'x'"
    assert any("GR3003" in n for n in read_grammar(text).notes)
    with pytest.raises(GrammarError, match="GR3003.*nope"):
        read_grammar(text, strict=True)
    assert any("never matches" in n for n in read_grammar("<T> ::= /^a/").notes)
    assert read_grammar("<T> ::= ''").tokens == []


def test_inheritance():
    g = read_grammar("Grammar: G\nInherits: antlr4_base\n<NUMBER> ::= /[0-9]/\n<p> ::= <IDENTIFIER> <NUMBER>")
    assert [(t.name, t.pattern) for t in g.tokens] == [("WS", r"/[ \t\r\n]+/"), ("IDENTIFIER", "/[a-zA-Z][a-zA-Z0-9]*/"), ("NUMBER", "/[0-9]/")]
    assert read_grammar("Inherits: bison_base").precedence["*"] == 2
    assert any("unknown base" in n for n in read_grammar("Inherits: nowhere").notes)
    with pytest.raises(GrammarError, match="GR3001"):
        read_grammar("Inherits: b", {"b": "Inheritable: false"})
    with pytest.raises(GrammarError, match="GR3002"):
        read_grammar("Grammar: a\nInherits: b", {"b": "Inherits: c", "c": "Inherits: b"})


BASE = "<WS> ::= /[ \\t\\r\\n]+/ => { skip(); }\n<IDENTIFIER> ::= /[a-zA-Z_][a-zA-Z0-9]*/\n<NUMBER> ::= /[0-9]+/\n<expr> ::= <term> ;\n<term> ::= IDENTIFIER | NUMBER ;"
OVER = "<IDENTIFIER> ::= /custom-[a-z]+/\n<META> ::= /\\$[A-Z]+/\n<term> ::= META ;\n<call> ::= META ;"


@pytest.mark.parametrize(("policy", "pattern", "terms"), [("OverlayWins", "/custom-[a-z]+/", 1), ("BaseWins", "/[a-zA-Z_][a-zA-Z0-9]*/", 2), ("Additive", "/[a-zA-Z_][a-zA-Z0-9]*/", 3), ("PriorityBased", "/custom-[a-z]+/", 1)])
def test_overlays(policy, pattern, terms):
    base = read_grammar(BASE, strict=False)
    out, conflicts = compose(base, read_grammar(OVER, strict=False), policy)
    assert next(t.pattern for t in out.tokens if t.name == "IDENTIFIER") == pattern
    assert len(rhs(out, "term")) == terms and len(rhs(out, "call")) == 1 and len(conflicts) == 2
    assert len(base.tokens) == 3 and len(rhs(base, "term")) == 2


def test_overlay_priorities_and_precedence():
    low, base, high = (Grammar(tokens=[TokenRule("I", f"/{p}/", priority=p)], productions=[Production("r", (str(p),), precedence=p)]) for p in (5, 10, 20))
    assert compose(base, low, "PriorityBased")[0].tokens[0].pattern == "/10/"
    assert compose(base, high, "PriorityBased")[0].tokens[0].pattern == "/20/"
    a, b = Grammar(precedence={"*": 2, "+": 1}), Grammar(precedence={"*": 5, "/": 3}, associativity={"+": "left"})
    assert compose(a, b)[0].precedence == {"*": 5, "+": 1, "/": 3} and compose(a, b, "BaseWins")[0].precedence == {"*": 2, "+": 1, "/": 3}
    assert compose_text(BASE, OVER)[1] and not compose(base, Grammar())[1]
    with pytest.raises(ValueError, match="policy"):
        compose(a, b, "None")
    twice = with_pattern_tokens(with_pattern_tokens(base))
    assert [t.name for t in twice.tokens] == ["I", "METAVARIABLE", "ELLIPSIS"]


def test_bad_ebnf():
    for body in ("( <a>", "<a> )", "* <a>", "( <a> | " * 3):
        with pytest.raises(EbnfError):
            Normalizer("x", set()).alternatives(body)
    with pytest.raises(EbnfError, match="alternatives"):
        Normalizer("x", set()).alternatives(" ".join(f"<a{i}>?" for i in range(13)))
