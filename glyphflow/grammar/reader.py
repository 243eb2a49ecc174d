"""Grammar text to a Grammar: headers, token rules, productions, precedence, projections, inheritance, validation.

Comment lines are left out before anything else, so a production never takes one in.
"""

from __future__ import annotations

import os
import re
from dataclasses import replace
from functools import lru_cache

from glyphflow.rules import validate_pattern

from .ebnf import EbnfError, Normalizer
from .model import Grammar, GrammarError, Production, Projection, TokenRule, matches_only_space

_HEADER = re.compile(r"^(Grammar|TokenSplitter|Inherits|Inheritable|FormatType)\s*:\s*(.*)$")
_OTHER_HEADER = re.compile(r"^[A-Z]\w*\s*:(?!:)")
_START = re.compile(r"^<([^<>]+)>\s*::=\s*")

# The built-in base grammars.
BUILT_IN = {
    "antlr4_base": Grammar("antlr4_base", tokens=[TokenRule("WS", r"/[ \t\r\n]+/", skippable=True), TokenRule("IDENTIFIER", "/[a-zA-Z][a-zA-Z0-9]*/"), TokenRule("NUMBER", "/[0-9]+/")]),
    "bison_base": Grammar("bison_base", precedence={"+": 1, "-": 1, "*": 2, "/": 2}, associativity=dict.fromkeys("+-*/", "left")),
}


class _Cursor:
    """Reads one line from left to right; white space between parts doesn't count."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def _next(self) -> str:
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def takes(self, mark: str) -> bool:
        self._next()
        found = self.text.startswith(mark, self.at)
        self.at += len(mark) * found
        return found

    def word(self) -> str:
        """Letters, digits and underscores; empty where something else stands."""
        self._next()
        start = self.at
        while (c := self.text[self.at : self.at + 1]) == "_" or c.isalnum():
            self.at += 1
        return self.text[start : self.at]

    def inside(self, opening: str, closing: str) -> str | None:
        """What a pair of brackets holds, pairs in it included; None where there is no such pair."""
        if not self.takes(opening):
            return None
        start, depth = self.at, 1
        while self.at < len(self.text):
            c = self.text[self.at]
            depth += (c == opening) - (c == closing)
            self.at += 1
            if not depth:
                return self.text[start : self.at - 1].strip()
        return None

    def value(self) -> str:
        """A quoted text without its quotes, or what stands before the next comma or bracket."""
        c = self._next()
        if c in ("'", '"') and (end := self.text.find(c, self.at + 1)) >= 0:
            out, self.at = self.text[self.at + 1 : end], end + 1
            return out
        start = self.at
        while self.text[self.at : self.at + 1] not in ("", ",", "]", "}"):
            self.at += 1
        return self.text[start : self.at].strip()

    def values(self) -> list[str]:
        """A value, or all of a list in square brackets."""
        if not self.takes("["):
            return [self.value()]
        out = []
        while self._next() and not self.takes("]"):
            if not self.takes(","):
                out.append(self.value())
        return out


def annotated(name: str) -> tuple[str, str, int]:
    """``name (context, priority:n)`` -> name, context, priority."""
    plain, _, notes = name.partition("(")
    context, priority = [], 0
    for note in notes.rpartition(")")[0].split(","):
        key, colon, n = (x.strip() for x in note.partition(":"))
        if key == "priority" and colon and n.isdigit():
            priority = int(n)
        elif note.strip():
            context.append(note.strip())
    return plain.strip(), ", ".join(context), priority


def _level(line: str) -> tuple[int, list[str], str] | None:
    """``LevelN: { operators: [...], associativity: "..." }``: the level, its operators and their associativity."""
    cursor = _Cursor(line)
    key = cursor.word()
    number = key.removeprefix("Level")
    if key == number or not number.isdigit() or not cursor.takes(":") or not cursor.takes("{"):
        return None
    fields: dict[str, list[str]] = {}
    while (name := cursor.word()) and cursor.takes(":"):
        fields[name] = cursor.values()
        cursor.takes(",")
    if not fields.get("operators") or not fields.get("associativity"):
        return None
    return int(number), fields["operators"], fields["associativity"][0]


def _projection(line: str) -> Projection | None:
    """``@context(c) @projection(pattern) rule => { code }`` on one line, whatever stands before it."""
    at = line.find("@context")
    cursor = _Cursor(line, max(at, 0))
    context = cursor.inside("(", ")") if cursor.takes("@context") else None
    pattern = cursor.inside("(", ")") if context and cursor.takes("@projection") else None
    rule = cursor.word() if pattern else ""
    code = cursor.inside("{", "}") if rule and not rule[0].isdigit() and cursor.takes("=>") else None
    return None if code is None else Projection(rule, context, pattern, code)


def split_action(text: str) -> tuple[str, str]:
    """The text before ``=>`` outside quotes and regexes, and the action in its braces."""
    quote = ""
    at = 0
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\" and quote == "/":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'" or (c == "/" and (at == 0 or text[at - 1] in " \t|(\n")):
            quote = c
        elif text.startswith("=>", at):
            return text[:at].strip(), text[at + 2 :].strip().strip(";").strip().removeprefix("{").removesuffix("}").strip()
        at += 1
    return text.strip(), ""


def split_alternatives(text: str) -> list[str]:
    """Parts between top-level bars; bars in groups, braces, quotes and regexes don't count."""
    out, depth, quote, start = [], 0, "", 0
    for at, c in enumerate(text):
        if quote:
            if c == quote and (quote != "/" or text[at - 1] != "\\"):
                quote = ""
        elif c in "\"'" or (c == "/" and (at == 0 or text[at - 1] in " \t|(\n")):
            quote = c
        elif c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(text[start:at])
            start = at + 1
    return [x.strip() for x in [*out, text[start:]]]


def _statements(lines: list[str]) -> list[tuple[str, str]]:
    """(annotated name, body); a body goes on until a line starts something else."""
    out: list[list[str]] = []
    open_ = False
    for line in lines:
        text = line.strip()
        if m := _START.match(text):
            out.append([m[1], text[m.end() :]])
            open_ = True
        elif not text or text.startswith("@") or _OTHER_HEADER.match(text):
            open_ = False
        elif open_:
            out[-1][1] += "\n" + text
    return [(n, b.strip()) for n, b in out]


def _single_terminal(body: str) -> str | None:
    text = body.strip()
    if text.endswith(";"):
        text = text[:-1].strip()
    if len(text) >= 2 and text[0] in "\"'" and text.find(text[0], 1) == len(text) - 1:
        return text
    if len(text) > 2 and text[0] == text[-1] == "/" and _one_regex(text):
        return text
    return None


def _one_regex(text: str) -> bool:
    """Whether the first regex of the text is all of it."""
    at, inside = 1, False
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "/":
            return at == len(text) - 1
        at += 1
    return False


def read_grammar_file(path: str, bases: dict[str, str] | None = None, strict: bool = False) -> Grammar:
    """The grammar of a file, decoded by its byte-order mark (UTF-8 without one).

    Without bases a file is read once for each of its versions: while its size and time stay, the same rules come back.
    """
    if bases:
        return read_grammar(_file_text(path), bases, strict)
    stat = os.stat(path)
    return _read_once(path, stat.st_mtime_ns, stat.st_size, strict).copy()


@lru_cache(maxsize=256)
def _read_once(path: str, changed: int, size: int, strict: bool) -> Grammar:
    return read_grammar(_file_text(path), strict=strict)


def _file_text(path: str) -> str:
    from glyphflow.functions.text import decode_bytes

    with open(path, "rb") as file:
        return decode_bytes(file.read())


def read_grammar(text: str, bases: dict[str, str] | None = None, strict: bool = False, inherit: bool = True) -> Grammar:
    """The grammar of a text.

    bases names further grammars that may be inherited. strict refuses undefined nonterminals; otherwise they are noted,
    as are patterns that never match.
    """
    grammar = Grammar()
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("#")]
    for line in lines:
        if m := _HEADER.match(line.strip()):
            key, value = m[1], m[2].strip()
            if key == "Grammar":
                grammar.name = value
            elif key == "TokenSplitter":
                grammar.token_splitter = value
            elif key == "Inherits":
                grammar.inherits = tuple(x.strip() for x in value.split(",") if x.strip())
            elif key == "Inheritable":
                grammar.inheritable = value.lower() != "false"
            else:
                grammar.format_type = value
    _precedence(lines, grammar)
    for line in lines:
        if found := _projection(line):
            grammar.projections[found.rule_name, found.context] = found
    statements = _statements(lines)
    productions = []
    for name, body in statements:
        first, action = split_action(body)
        terminal = _single_terminal(first)
        if terminal is None:
            if first in ('""', "''"):
                grammar.notes.append(f"token rule <{name}> matches only the empty string and is left out")
            else:
                productions.append((name, body))
            continue
        plain, context, priority = annotated(name)
        if len(terminal) == 2:
            grammar.notes.append(f"token rule <{plain}> matches only the empty string and is left out")
            continue
        if error := validate_pattern(terminal):
            grammar.notes.append(f"token rule <{plain}> {terminal} never matches: {error}")
        grammar.tokens.append(TokenRule(plain, terminal, context, priority, "skip" in action, action))
    optional = {t.name for t in grammar.tokens if not t.skippable and matches_only_space(t.pattern)}
    for name, body in productions:
        _production(grammar, name, body, optional)
    grammar.contexts = list(dict.fromkeys(c for c in [*(t.context for t in grammar.tokens), *(p.context for p in grammar.productions)] if c))
    if inherit and grammar.inherits:
        grammar = _inherited(grammar, bases or {}, (grammar.name,))
    missing = grammar.undefined()
    if missing:
        if strict:
            raise GrammarError(f"GR3003: undefined nonterminals: {', '.join(missing)}")
        grammar.notes.append(f"GR3003: undefined nonterminals: {', '.join(missing)}")
    return grammar


def _production(grammar: Grammar, name: str, body: str, optional: set[str]) -> None:
    plain, context, _ = annotated(name)
    used = sum(1 for p in {p.name for p in grammar.productions} if p.startswith(f"{plain}__rep"))
    normalizer = Normalizer(plain, optional, used + 1)
    for alternative in split_alternatives(body):
        rhs, action = split_action(alternative)
        try:
            found = normalizer.alternatives(rhs)
        except EbnfError as e:
            grammar.notes.append(f"production <{plain}>: {e}")
            continue
        new = [Production(plain, r, context, action=action) for r in found if r]
        grammar.productions += [p for p in new if p not in grammar.productions]
    grammar.productions += [Production(n, r, context) for n, r in dict.fromkeys(normalizer.helpers)]


def _precedence(lines: list[str], grammar: Grammar) -> None:
    inside = False
    for line in (x.strip() for x in lines):
        if line.startswith("Precedence:"):
            inside = True
        elif inside and (not line or line.startswith("}")):
            inside = False
        elif inside and (found := _level(line)):
            level, operators, associativity = found
            grammar.precedence.update(dict.fromkeys(operators, level))
            grammar.associativity.update(dict.fromkeys(operators, associativity))


def _inherited(grammar: Grammar, bases: dict[str, str], seen: tuple[str, ...]) -> Grammar:
    """What the bases define and the grammar doesn't, before the grammar's own."""
    out = grammar.copy()
    for name in grammar.inherits:
        if name in seen:
            raise GrammarError(f"GR3002: inheritance goes round: {' -> '.join((*seen, name))}")
        if name in bases:
            base = replace(read_grammar(bases[name], strict=False, inherit=False), name=name)
        elif name.lower() in BUILT_IN:
            base = BUILT_IN[name.lower()]
        else:
            out.notes.append(f"unknown base grammar {name}")
            continue
        if not base.inheritable:
            raise GrammarError(f"GR3001: grammar {name} is not inheritable")
        if base.inherits:
            base = _inherited(base, bases, (*seen, name))
        own_tokens, own_rules = {t.name for t in out.tokens}, {p.name for p in out.productions}
        out.tokens = [t for t in base.tokens if t.name not in own_tokens] + out.tokens
        out.productions = [p for p in base.productions if p.name not in own_rules] + out.productions
        out.precedence = {**base.precedence, **out.precedence}
        out.associativity = {**base.associativity, **out.associativity}
        out.contexts = list(dict.fromkeys([*base.contexts, *out.contexts]))
    return out
