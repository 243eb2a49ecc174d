"""Token-rule patterns: /regex/, quoted or bare literals, compiled once into matchers.

A compiled rule carries two forms of the same matcher: a Java pattern for plans that stay in the JVM, and a Python
matcher for documents that need path exploration. Quantified atoms never give back what they took, so both forms use
possessive quantifiers; only groups and alternation need an automaton, which takes the longest match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from glyphflow.functions.unicode_tables import LAST, Ranges, inverted, merged, normalize_name, property_ranges

# The bounds of the pattern language.
UNBOUNDED, MAX_REPEAT, MAX_STATES = 1_000_000, 64, 4_096

DIGITS, SPACES, BLANKS = ((0x30, 0x39),), ((0x09, 0x0D), (0x20, 0x20)), ((0x09, 0x09), (0x20, 0x20))
WORD = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
NOT_NEWLINE = ((0, 9), (11, LAST))
#: Escapes that stand for one character.
ESCAPES = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "a": 7, "e": 27, "0": 0}
SHORTHANDS = {"d": DIGITS, "w": WORD, "s": SPACES, "h": BLANKS}
#: Patterns with matchers of their own.
RUNS = {
    "[0-9]+": "DigitRun",
    "[a-zA-Z][a-zA-Z0-9]*": "IdentifierRun",
    r"[ \t\r\n]+": "WhitespaceRun",
    r"\$[A-Z_][A-Z0-9_]*": "MetavariableRun",
}


class PatternError(ValueError):
    """A construct outside the token-rule language."""


@dataclass(frozen=True)
class Atom:
    chars: Ranges
    least: int = 1
    most: int = 1
    #: A string that repeats as a whole (a quoted literal); chars then holds nothing.
    text: str | None = None


@dataclass
class CompiledRule:
    name: str
    pattern: str
    priority: int = 0
    ordinal: int = 0
    context: str = ""
    skippable: bool = False
    action: str = ""
    kind: str = "NeverMatches"
    error: str | None = None
    ignore_case: bool = False
    atoms: tuple[Atom, ...] | None = None
    literal: str | None = None
    tree: tuple | None = field(default=None, repr=False)

    @property
    def java_regex(self) -> str | None:
        """A Java pattern with the same match at a position; None where an automaton is needed or nothing matches."""
        if self.kind == "RegexNfa" or self.error:
            return None
        return "".join(_atom_regex(a, self.ignore_case) for a in self.atoms or ())

    @property
    def first(self) -> Ranges:
        """Characters that a match can start with."""
        if self.error:
            return ()
        if self.kind == "RegexNfa":
            return automaton(self.tree).first()
        out: list = []
        for a in self.atoms or ():
            out += _fold(((ord(a.text[0]), ord(a.text[0])),), self.ignore_case) if a.text else a.chars
            if a.least:
                break
        return merged(out)

    def matcher(self):
        """(text, position) -> end of the match, or -1; an empty match is no match."""
        if self.error:
            return lambda text, at: -1
        if self.kind == "RegexNfa":
            run = automaton(self.tree).longest
            return lambda text, at: end if (end := run(text, at)) > at else -1
        found = re.compile("".join(_atom_regex(a, self.ignore_case, python=True) for a in self.atoms)).match
        return lambda text, at: m.end() if (m := found(text, at)) and m.end() > at else -1


def _fold(ranges: Ranges, on: bool) -> Ranges:
    """The ranges with the simple other case of their letters."""
    if not on:
        return ranges
    out = list(ranges)
    for a, b in ranges:
        if b - a > 0x3000:
            continue  # such a range holds both cases
        for cp in range(a, b + 1):
            for other in (chr(cp).lower(), chr(cp).upper()):
                if len(other) == 1 and cp <= 0xFFFF:
                    out.append((ord(other), ord(other)))
    return merged(out)


def _point(cp: int, python: bool) -> str:
    c = chr(cp)
    if c.isascii() and c.isalnum():
        return c
    if python:
        return f"\\u{cp:04x}" if cp <= 0xFFFF else f"\\U{cp:08x}"
    return f"\\x{{{cp:X}}}"


#: Short Java spellings of sets that hold many ranges.
_SPELLED: dict[Ranges, str] = {}


def char_class(ranges: Ranges, python: bool = False) -> str:
    """A bracket expression for the ranges, the same in Java, Python and RE2 but for the spelling of code points."""
    if not ranges:
        return "[^\\s\\S]" if python else r"[^\x{0}-\x{10FFFF}]"
    if not python and ranges in _SPELLED:
        return _SPELLED[ranges]
    return "[" + "".join(_point(a, python) if a == b else f"{_point(a, python)}-{_point(b, python)}" for a, b in ranges) + "]"


def _atom_regex(atom: Atom, ignore_case: bool, python: bool = False) -> str:
    if atom.text is not None:
        body = "".join(char_class(_fold(((ord(c), ord(c)),), ignore_case), python) for c in atom.text)
        body = f"(?:{body})" if (atom.least, atom.most) != (1, 1) else body
    else:
        body = char_class(atom.chars, python)
    if (atom.least, atom.most) == (1, 1):
        return body
    count = f"{{{atom.least}}}" if atom.least == atom.most else f"{{{atom.least},{'' if atom.most >= UNBOUNDED else atom.most}}}"
    return f"{body}{count}+"


class _Reader:
    """A recursive reader of one regex body."""

    def __init__(self, body: str, ignore_case: bool, spaced: bool):
        self.s, self.at, self.ignore_case, self.spaced = body, 0, ignore_case, spaced
        self.grouped = False

    def peek(self) -> str:
        return self.s[self.at] if self.at < len(self.s) else ""

    def alternatives(self, inside: bool):
        options = [self.sequence(inside)]
        while self.peek() == "|":
            self.at += 1
            self.grouped = True
            options.append(self.sequence(inside))
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self, inside: bool):
        items = []
        while self.at < len(self.s) and self.peek() != "|":
            c = self.peek()
            if c == ")":
                if inside:
                    break
                raise PatternError("unbalanced )")
            if self.spaced and (c.isspace() or c == "#"):
                self.at = self.s.find("\n", self.at) + 1 or len(self.s) if c == "#" else self.at + 1
                continue
            items.append(self.quantified(self.item()))
        return ("then", [i for i in items if i is not None])

    def item(self):
        c = self.s[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            return ("set", self.bracket())
        if c == "\\":
            return self.escape()
        if c in "^$":
            raise PatternError(f"anchor {c} is not supported")
        if c in "*+?":
            raise PatternError(f"quantifier {c} has nothing to repeat")
        self.at += 1
        return ("set", NOT_NEWLINE if c == "." else _fold(((ord(c), ord(c)),), self.ignore_case))

    def group(self):
        self.grouped = True
        self.at += 1
        if self.peek() == "?":
            if self.s.startswith(("?:", "?>"), self.at):
                self.at += 2
            else:
                kind = "lookaround" if re.match(r"\?<?[=!]", self.s[self.at :]) else "named group" if re.match(r"\?P?[<']", self.s[self.at :]) else "scoped modifier"
                raise PatternError(f"{kind} is not supported")
        body = self.alternatives(True)
        if self.peek() != ")":
            raise PatternError("unclosed group")
        self.at += 1
        return body

    def escape(self):
        s = self.s
        if self.at + 1 >= len(s):
            raise PatternError("lone backslash at the end")
        c = s[self.at + 1]
        if c == "Q":
            end = s.find("\\E", self.at + 2)
            text = s[self.at + 2 : end if end >= 0 else len(s)]
            self.at = end + 2 if end >= 0 else len(s)
            return ("text", text) if text else None
        if c in "pP":
            return ("set", self.property())
        if c.lower() in SHORTHANDS:
            self.at += 2
            chars = SHORTHANDS[c.lower()]
            return ("set", chars if c.islower() else inverted(chars))
        if c in "bBAZzG":
            self.at += 2
            return ("boundary", c)
        if c in "123456789" or c == "k":
            self.at += 2
            return ("back", c)
        cp = self.single()
        return ("set", _fold(((cp, cp),), self.ignore_case))

    def single(self) -> int:
        """The code point of the escape at the cursor."""
        c = self.s[self.at + 1]
        if c == "x":
            if m := re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(self.s, self.at):
                self.at = m.end()
                cp = int(m[1] or m[2], 16)
                if cp > LAST:
                    raise PatternError(f"code point {cp:X} is out of range")
                return cp
            raise PatternError("malformed \\x escape")
        self.at += 2
        return ESCAPES.get(c, ord(c))

    def property(self) -> Ranges:
        m = re.compile(r"\\([pP])(?:\{(\^?)([^}]*)\}|(.))").match(self.s, self.at)
        if not m:
            raise PatternError("malformed property")
        self.at = m.end()
        ranges = property_ranges(m[3] or m[4] or "")
        if ranges is None:
            raise PatternError(f"unknown Unicode property {m[3] or m[4]}")
        negated = (m[1] == "P") != bool(m[2])
        ranges = inverted(ranges) if negated else ranges
        name, kind = normalize_name(m[3] or m[4])
        if kind == "category":
            _SPELLED[ranges] = f"[\\{'P' if negated else 'p'}{{{name}}}]"
        return ranges

    def bracket(self) -> Ranges:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        out: list = []
        first, spelled = True, ""
        while first or self.peek() != "]":
            low, first = self.member(), False
            if not isinstance(low, int):
                out += low
                spelled += _SPELLED.get(low) or char_class(low)
                continue
            high = low
            if self.peek() == "-" and self.s[self.at + 1 : self.at + 2] not in ("]", ""):
                mark = self.at
                self.at += 1
                high = self.member()
                if not isinstance(high, int):
                    self.at, high = mark, low  # a shorthand ends no range, so the hyphen is a member
                elif high < low:
                    raise PatternError("character range out of order")
            out.append((low, high))
            spelled += char_class(((low, high),))
        self.at += 1
        ranges = _fold(merged(out), self.ignore_case)
        ranges = inverted(ranges) if negated else ranges
        if len(ranges) > 40 and not self.ignore_case:
            _SPELLED[ranges] = f"[{'^' if negated else ''}{spelled}]"
        return ranges

    def member(self) -> int | Ranges:
        """One code point of a class, or the set of a shorthand or property."""
        c = self.peek()
        if not c:
            raise PatternError("unclosed character class")
        if c == "\\" and self.at + 1 < len(self.s):
            e = self.s[self.at + 1]
            if e in "pP":
                return self.property()
            if e.lower() in SHORTHANDS:
                self.at += 2
                return SHORTHANDS[e] if e.islower() else inverted(SHORTHANDS[e.lower()])
            return self.single()
        self.at += 1
        return ord(c)

    def quantified(self, item):
        least, most, given = 1, 1, False
        c = self.peek()
        if c and c in "*+?":
            least, most, given = {"*": (0, UNBOUNDED), "+": (1, UNBOUNDED), "?": (0, 1)}[c] + (True,)
            self.at += 1
        elif c == "{" and (m := re.compile(r"\{(\d+)(?:(,)(\d*))?\}").match(self.s, self.at)):
            least, given = int(m[1]), True
            most = least if not m[2] else int(m[3]) if m[3] else UNBOUNDED
            if most < least:
                raise PatternError("quantifier range out of order")
            self.at = m.end()
        if given and self.peek() == "?":
            most = least  # a lazy quantifier takes its least
            self.at += 1
        elif given and self.peek() == "+":
            self.at += 1
        return item if item is None or not given else ("repeat", item, least, most)


def _prepared(body: str) -> tuple[str, bool, bool]:
    """The body without comments and leading global modifiers; ignore case; extended spacing."""
    body = re.sub(r"(?<!\\)\(\?#[^)]*\)", "", body)
    ignore_case = spaced = False
    while m := re.match(r"\(\?([imsxJUX]*)(?:-([imsxJUX]*))?\)", body):
        ignore_case = ("i" in m[1]) or (ignore_case and "i" not in (m[2] or ""))
        spaced = ("x" in m[1]) or (spaced and "x" not in (m[2] or ""))
        body = body[m.end() :]
    return body, ignore_case, spaced


def _flat(tree) -> tuple[Atom, ...] | None:
    """The atoms of a tree without groups."""
    atoms = []
    for item in tree[1]:
        least = most = 1
        if item[0] == "repeat":
            _, item, least, most = item
        if item[0] == "set":
            atoms.append(Atom(item[1], least, most))
        elif item[0] == "text":
            atoms.append(Atom((), least, most, item[1]))
        elif item[0] in ("boundary", "back"):
            atoms.append(Atom(((ord(item[1]), ord(item[1])),), least, most))
        else:
            return None
    return tuple(a for a in atoms if a.most)


def _check(tree) -> None:
    kind = tree[0]
    if kind == "boundary":
        raise PatternError(f"boundary \\{tree[1]} is not supported")
    if kind == "back":
        raise PatternError("backreference is not supported")
    if kind in ("or", "then"):
        for t in tree[1]:
            _check(t)
    if kind == "repeat":
        if max(tree[2], 0 if tree[3] >= UNBOUNDED else tree[3]) > MAX_REPEAT:
            raise PatternError(f"more than {MAX_REPEAT} repeats in a group pattern")
        _check(tree[1])


def compile_rule(name: str, pattern: str, priority: int = 0, ordinal: int = 0, context: str = "", skippable: bool = False, action: str = "") -> CompiledRule:
    """The rule with its matcher; a pattern outside the language gives one that never matches and says why."""
    rule = CompiledRule(name, pattern, priority, ordinal, context, skippable, action)
    if len(pattern) >= 2 and pattern[0] == "/" and pattern[-1] == "/":
        body = pattern[1:-1]
        if body in RUNS:
            rule.kind = RUNS[body]
        try:
            plain, rule.ignore_case, spaced = _prepared(body)
            reader = _Reader(plain, rule.ignore_case, spaced)
            tree = reader.alternatives(False)
            if not reader.grouped:
                rule.atoms = _flat(tree)
                if not rule.atoms:
                    raise PatternError("matches only the empty string")
                if rule.kind == "NeverMatches":
                    only = rule.atoms[0] if len(rule.atoms) == 1 else None
                    rule.kind = "QuotedLiteral" if only and only.text else "UnicodeProperty" if only and re.fullmatch(r"\\[pP]\{[^}]*\}.*", plain) else "ClassSequence"
            else:
                _check(tree)
                rule.kind, rule.tree = "RegexNfa", tree
                if len(automaton(tree).moves) > MAX_STATES:
                    raise PatternError(f"more than {MAX_STATES} states")
        except (PatternError, RecursionError) as e:
            rule.kind, rule.error, rule.atoms, rule.tree = "NeverMatches", str(e), None, None
        return rule
    literal = pattern[1:-1] if len(pattern) >= 2 and pattern[0] in "\"'" and pattern[-1] == pattern[0] else pattern
    if literal.startswith("(?i)"):
        rule.ignore_case, literal = True, literal[4:]
    if not literal:
        rule.error = "matches only the empty string"
        return rule
    rule.kind, rule.literal, rule.atoms = "Literal", literal, (Atom((), 1, 1, literal),)
    return rule


def validate_pattern(pattern: str) -> str | None:
    """Why a pattern never matches, or None."""
    return compile_rule("", pattern).error


class Automaton:
    """A nondeterministic automaton whose determinised states are built as they are met."""

    def __init__(self, tree):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[Ranges, int] | None] = []
        start, end = self._build(tree)
        self.end = end
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.table: list[dict[str, int]] = []
        self.start = self._state({start})

    def _node(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        if len(self.moves) > 8 * MAX_STATES:
            raise PatternError(f"more than {MAX_STATES} states")
        return len(self.moves) - 1

    def _build(self, tree) -> tuple[int, int]:
        kind = tree[0]
        if kind == "set":
            a, b = self._node(), self._node()
            self.moves[a] = (tree[1], b)
            return a, b
        if kind == "text":
            return self._build(("then", [("set", ((ord(c), ord(c)),)) for c in tree[1]]))
        if kind == "then":
            start = end = self._node()
            for t in tree[1]:
                a, b = self._build(t)
                self.empty[end].append(a)
                end = b
            return start, end
        if kind == "or":
            start, end = self._node(), self._node()
            for t in tree[1]:
                a, b = self._build(t)
                self.empty[start].append(a)
                self.empty[b].append(end)
            return start, end
        _, inner, least, most = tree
        start = end = self._node()
        for _ in range(least):
            a, b = self._build(inner)
            self.empty[end].append(a)
            end = b
        if most >= UNBOUNDED:
            a, b = self._build(inner)
            last = self._node()
            self.empty[end] += [a, last]
            self.empty[b] += [a, last]
            return start, last
        last = self._node()
        for _ in range(most - least):
            self.empty[end].append(last)
            a, b = self._build(inner)
            self.empty[end].append(a)
            end = b
        self.empty[end].append(last)
        return start, last

    def _state(self, seeds: set[int]) -> int:
        todo, seen = list(seeds), set(seeds)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        key = frozenset(n for n in seen if self.moves[n] or n == self.end)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.table.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        cp = ord(c)
        onward = {m[1] for n in self.members[state] if (m := self.moves[n]) and any(a <= cp <= b for a, b in m[0])}
        to = self._state(onward) if onward else -1
        self.table[state][c] = to
        return to

    def longest(self, text: str, at: int) -> int:
        state, best = self.start, -1
        n = len(text)
        while True:
            if self.end in self.members[state]:
                best = at
            if at >= n:
                return best
            state = self.table[state].get(text[at], -2) if (c := text[at]) in self.table[state] else self._step(state, c)
            if state < 0:
                return best
            at += 1

    def first(self) -> Ranges:
        return merged(r for n in self.members[self.start] if self.moves[n] for r in self.moves[n][0])


def _frozen(tree):
    return tuple(_frozen(t) if isinstance(t, (tuple, list)) else t for t in tree)


@lru_cache(maxsize=512)
def _automaton(tree) -> Automaton:
    return Automaton(tree)


def automaton(tree) -> Automaton:
    return _automaton(_frozen(tree))


def known_property(name: str) -> bool:
    return normalize_name(name) is not None
