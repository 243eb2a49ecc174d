"""EBNF right-hand sides as plain alternatives.

? gives the alternatives with and without; * and + give a right-recursive helper rule, which * may also leave out;
groups are multiplied into their owner; empty alternatives are dropped.
"""

from __future__ import annotations

import re
from itertools import product

# Fixed value: alternatives beyond this are refused.
MAX_ALTERNATIVES = 4096
_TOKEN = re.compile(r"""\s*(?:(?P<ref><[^<>]+>)|(?P<lit>'[^']*'|"[^"]*")|(?P<regex>/(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/)|(?P<note>@\w+(?:\[[^\]]*\]|\([^)]*\))?)|(?P<word>[\w.-]+)|(?P<mark>[()|?*+;]))""")
EMPTY = {"ε", "epsilon", "EMPTY"}


class EbnfError(ValueError):
    pass


def tokens(body: str) -> list[tuple[str, str]]:
    out, at = [], 0
    body = body.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise EbnfError(f"unexpected {body[at : at + 20]!r}")
        kind, text = m.lastgroup, m.group(m.lastgroup)
        at = m.end()
        if kind == "note" or text == ";":
            continue
        out.append((kind, re.sub(r"\s*\(.*\)$", "", text[1:-1]).strip() if kind == "ref" else text))
    return out


class Normalizer:
    """Alternatives of one owner; helpers collects the rules that repetition needs."""

    def __init__(self, owner: str, optional: set[str], first_helper: int = 1):
        self.owner, self.optional = owner, optional
        self.helpers: list[tuple[str, tuple[str, ...]]] = []
        self.number = first_helper

    def alternatives(self, body: str) -> list[tuple[str, ...]]:
        self.items, self.at = tokens(body), 0
        found = self._choice()
        if self.at < len(self.items):
            raise EbnfError("unbalanced )")
        return _distinct(found)

    def _choice(self) -> list[tuple[str, ...]]:
        out = self._sequence()
        while self._mark("|"):
            out = out + self._sequence()
        if len(out) > MAX_ALTERNATIVES:
            raise EbnfError(f"more than {MAX_ALTERNATIVES} alternatives")
        return out

    def _mark(self, text: str) -> bool:
        if self.at < len(self.items) and self.items[self.at] == ("mark", text):
            self.at += 1
            return True
        return False

    def _sequence(self) -> list[tuple[str, ...]]:
        parts: list[list[tuple[str, ...]]] = []
        while self.at < len(self.items):
            kind, text = self.items[self.at]
            if kind == "mark" and text in "|)":
                break
            self.at += 1
            if kind == "mark" and text == "(":
                options = self._choice()
                if not self._mark(")"):
                    raise EbnfError("unclosed (")
            elif kind == "mark":
                raise EbnfError(f"{text} has nothing to repeat")
            else:
                options = [()] if text in EMPTY else [(text,), ()] if text in self.optional else [(text,)]
            parts.append(self._quantified(options))
            size = 1
            for p in parts:
                size *= len(p)
            if size > MAX_ALTERNATIVES:
                raise EbnfError(f"more than {MAX_ALTERNATIVES} alternatives")
        return [tuple(s for part in pick for s in part) for pick in product(*parts)]

    def _quantified(self, options: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        if self._mark("?"):
            return _distinct([*options, ()])
        again = "*" if self._mark("*") else "+" if self._mark("+") else ""
        if not again:
            return options
        some = [o for o in options if o]
        if not some:
            return [()]
        name = f"{self.owner}__rep{self.number}"
        self.number += 1
        for o in some:
            self.helpers += [(name, (*o, name)), (name, o)]
        return [(name,), ()] if again == "*" or () in options else [(name,)]


def _distinct(found: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(found))
