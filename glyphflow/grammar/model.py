"""What a grammar file says, as plain records that render to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from glyphflow.rules import CompiledRule, compile_rule

# Priorities of the rules that are added where a grammar has none.
LOWEST = -(2**31)
PATTERN_TOKEN_PRIORITY = 1000


class GrammarError(ValueError):
    """A grammar that can't be used; the message starts with its diagnostic code."""


@dataclass(frozen=True)
class TokenRule:
    name: str
    pattern: str
    context: str = ""
    priority: int = 0
    skippable: bool = False
    action: str = ""


@dataclass(frozen=True)
class Production:
    name: str
    rhs: tuple[str, ...]
    context: str = ""
    precedence: int = 0
    associativity: str = ""
    action: str = ""


@dataclass(frozen=True)
class Projection:
    rule_name: str
    context: str
    pattern: str
    code: str


@dataclass
class Grammar:
    name: str = ""
    token_splitter: str = ""
    inherits: tuple[str, ...] = ()
    inheritable: bool = True
    format_type: str = ""
    tokens: list[TokenRule] = field(default_factory=list)
    productions: list[Production] = field(default_factory=list)
    precedence: dict[str, int] = field(default_factory=dict)
    associativity: dict[str, str] = field(default_factory=dict)
    projections: dict[tuple[str, str], Projection] = field(default_factory=dict)
    contexts: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def copy(self) -> Grammar:
        return replace(self, tokens=list(self.tokens), productions=list(self.productions), precedence=dict(self.precedence), associativity=dict(self.associativity), projections=dict(self.projections), contexts=list(self.contexts), notes=list(self.notes))

    def projection(self, rule_name: str, context: str) -> Projection | None:
        return self.projections.get((rule_name, context))

    def root_rules(self) -> set[str]:
        """Left-hand sides that no right-hand side mentions."""
        used = {s for p in self.productions for s in p.rhs}
        return {p.name for p in self.productions} - used

    def undefined(self) -> list[str]:
        """Symbols on right-hand sides that are neither rules nor literals."""
        known = {t.name for t in self.tokens} | {p.name for p in self.productions}
        return sorted({s for p in self.productions for s in p.rhs if s not in known and not is_terminal(s)})

    def whitespace_tokens(self) -> set[str]:
        return {t.name for t in self.tokens if matches_only_space(t.pattern)}

    def ignorable(self) -> set[str]:
        """Whitespace-only tokens that no production mentions."""
        return self.whitespace_tokens() - {s for p in self.productions for s in p.rhs}

    def rule_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, r.ordinal, r.name, r.pattern, r.context, r.priority, r.skippable, r.kind, r.java_regex, r.error) for r in self.lexer_rules()]
        return spark.createDataFrame(rows, "grammar string, ordinal int, name string, pattern string, context string, priority int, is_skippable boolean, kind string, java_regex string, validation_error string")

    def production_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, i, p.name, list(p.rhs), p.context, p.precedence, p.associativity) for i, p in enumerate(self.productions)]
        return spark.createDataFrame(rows, "grammar string, rule_index int, name string, rhs array<string>, context string, precedence int, associativity string")

    def materialized(self) -> Grammar:
        """Literals and regexes on right-hand sides become token rules, or the name of a rule with the same literal."""
        out = self.copy()
        by_literal: dict[str, str] = {}
        for t in out.tokens:
            if (core := quoted(t.pattern)) is not None and not t.context:
                by_literal.setdefault(core, t.name)
        known = {t.name for t in out.tokens}
        productions = []
        for p in out.productions:
            rhs = []
            for s in p.rhs:
                core = quoted(s)
                if core is not None and core in by_literal:
                    s = by_literal[core]
                elif is_terminal(s) and s not in known:
                    known.add(s)
                    out.tokens.append(TokenRule(s, s))
                rhs.append(s)
            productions.append(replace(p, rhs=tuple(rhs), precedence=out.precedence.get(p.name, p.precedence)))
        out.productions = productions
        return out

    def lexer_rules(self, defaults: bool = True) -> list[CompiledRule]:
        """Compiled rules by falling priority, then declaration; with the default whitespace and comment rules."""
        tokens = list(self.materialized().tokens) if defaults else list(self.tokens)
        if defaults:
            if not any(matches_only_space(t.pattern) for t in tokens):
                tokens.append(TokenRule("__default_ws", r"/[ \t\r\n]+/", priority=LOWEST + 1, skippable=True))
            if not any("comment" in t.name.lower() for t in tokens):
                tokens.append(TokenRule("__default_comment", r"/#[^\n]*/", priority=LOWEST, skippable=True))
        rules = [compile_rule(t.name, t.pattern, t.priority, i, t.context, t.skippable, t.action) for i, t in enumerate(tokens)]
        return sorted(rules, key=lambda r: (-r.priority, r.ordinal))


def quoted(symbol: str) -> str | None:
    """What stands between a symbol's quotes."""
    return symbol[1:-1] if len(symbol) > 2 and symbol[0] in "\"'" and symbol[-1] == symbol[0] else None


def is_terminal(symbol: str) -> bool:
    return quoted(symbol) is not None or (len(symbol) > 2 and symbol[0] == symbol[-1] == "/")


def matches_only_space(pattern: str) -> bool:
    """Whether a pattern matches nothing but white space."""
    rule = compile_rule("", pattern)
    if rule.error or rule.kind == "RegexNfa":
        return False
    space = {9, 10, 11, 12, 13, 32}
    for a in rule.atoms or ():
        points = {ord(c) for c in a.text} if a.text is not None else {cp for x, y in a.chars if y - x < 64 for cp in range(x, y + 1)} or {0}
        if any(y - x >= 64 for x, y in a.chars) or not points <= space:
            return False
    return True
