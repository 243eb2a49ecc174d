"""The general lexer: all rules at every position, longest match or all paths. No Spark here.

Positions inside are characters; spans in results are UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from glyphflow.rules import CompiledRule

# The lexer's bounds.
PATH_BUDGET, STALL_WINDOW, STEPS_PER_BYTE = 64, 10, 10
_HEX_ESCAPE = re.compile(r"\\x\{([^}]+)\}")
_RETURN = re.compile(r'return\("([^"]+)"\)')


@dataclass
class Token:
    type: str
    value: str
    start: int
    end: int
    context: str = "default"
    path: int = 0
    step: int = 0


@dataclass
class LexResult:
    tokens: list[Token] = field(default_factory=list)
    completed: bool = True
    #: Byte where the furthest path found no rule; -1 if none did.
    unmatched: int = -1
    stalled: bool = False
    #: (path, position, tokens, valid, token types) when the run ended.
    paths: list[tuple[int, int, int, bool, tuple[str, ...]]] = field(default_factory=list)
    most_active: int = 1
    attempts: int = 0
    wasted: int = 0


class Positions:
    """Byte offsets and line starts of a text."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        self.bytes = None if self.ascii else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
        self.n = len(text)
        self.lines = [0, *(self.byte(m.end()) for m in re.finditer("\n", text))]

    def byte(self, at: int) -> int:
        return at if self.ascii else self.bytes[at]

    def char(self, offset: int) -> int:
        return min(offset, self.n) if self.ascii else bisect_right(self.bytes, offset) - 1

    def line_column(self, offset: int) -> tuple[int, int]:
        """1-based line, and 1-based column in bytes."""
        line = bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1


def split_escapes(value: str) -> list[tuple[str, str]]:
    """The parts of a token that holds hexadecimal escapes; empty for any other token."""
    return [("HEX_ESCAPE", m) for m in _HEX_ESCAPE.findall(value)]


class Lexer:
    def __init__(self, rules: list[CompiledRule], budget: int = PATH_BUDGET, contexts: tuple[str, ...] = ("default",), prioritizer=None):
        stack = set(contexts) | {"default"}
        self.rules = [r for r in rules if not r.error and (not r.context or r.context in stack)]
        self.match = [r.matcher() for r in self.rules]
        self.retype = [m[1] if (m := _RETURN.search(r.action)) else r.name for r in self.rules]
        self.budget, self.prioritizer = budget, prioritizer
        # Rules by first character: a table for ASCII, and those that may start with anything else.
        starts = [r.first for r in self.rules]
        self.by_first = [[i for i, s in enumerate(starts) if any(a <= c <= b for a, b in s)] for c in range(128)]
        self.others = [i for i, s in enumerate(starts) if s and s[-1][1] > 127]

    def _candidates(self, c: str) -> list[int]:
        return self.by_first[ord(c)] if c < "\x80" else self.others

    def matches(self, text: str, at: int, result: LexResult | None = None) -> list[tuple[int, int]]:
        """(rule, end) of every rule that matches here, in rule order."""
        tried = self._candidates(text[at])
        if self.prioritizer is not None and len(tried) > 1:
            first = text[at].encode("utf-8", "surrogatepass")[0]
            tried = sorted(tried, key=lambda i: (-self.prioritizer(self.rules[i], first), i))
        found, wasted = [], 0
        for i in tried:
            end = self.match[i](text, at)
            if end > at:
                found.append((i, end))
            elif not found:
                wasted += 1
        if result is not None:
            result.attempts += len(tried)
            result.wasted += wasted
        return sorted(found)

    def greedy(self, text: str, start: int = 0, stop=None) -> LexResult:
        """The longest match at each position, ties to the earlier rule. stop(token) may end the run after a token."""
        result, at, n = LexResult(), start, len(text)
        where = Positions(text)
        seq = 0
        while at < n:
            found = self.matches(text, at, result)
            if not found:
                result.completed, result.unmatched = False, where.byte(at)
                break
            rule, end = max(found, key=lambda x: (x[1], -x[0]))
            if not self.rules[rule].skippable:
                result.tokens.append(Token(self.retype[rule], text[at:end], where.byte(at), where.byte(end), step=seq))
                if stop is not None and stop(result.tokens[-1]):
                    at = end
                    break
            at, seq = end, seq + 1
        result.paths = [(0, where.byte(at), len(result.tokens), result.completed, tuple(t.type for t in result.tokens))]
        return result

    def explore(self, text: str) -> LexResult:
        """One path for every way to read the text, merged where they agree and held to the budget.

        Tokens are a bag over all paths in step order, those of paths that die later included.
        """
        result, n = LexResult(), len(text)
        where = Positions(text)
        # A path: id, position, number of its interned token types, count of tokens.
        interned: dict[tuple[int, str], int] = {}
        parents: list[tuple[int, str]] = [(-1, "")]
        paths, next_id, step, reached = [(0, 0, 0, 0)], 1, 0, 0
        done: list[tuple[int, int, int, int]] = []
        dead: list[tuple[int, int, int, int]] = []
        limit = STEPS_PER_BYTE * max(1, where.byte(n))
        while paths and step < limit:
            onward: list[tuple[int, int, int, int]] = []
            for path in paths:
                number, at, types, count = path
                if at >= n:
                    done.append(path)
                    continue
                found = self.matches(text, at, result)
                if not found:
                    result.unmatched = max(result.unmatched, where.byte(at))
                    dead.append(path)
                for rule, end in found:
                    own = number if len(found) == 1 else next_id
                    next_id += len(found) > 1
                    if self.rules[rule].skippable:
                        onward.append((own, end, types, count))
                        continue
                    result.tokens.append(Token(self.retype[rule], text[at:end], where.byte(at), where.byte(end), path=own, step=step))
                    key = (types, self.rules[rule].name)
                    if key not in interned:
                        interned[key] = len(parents)
                        parents.append(key)
                    onward.append((own, end, interned[key], count + 1))
            merged: dict[tuple[int, int], tuple[int, int, int, int]] = {}
            for path in onward:
                merged.setdefault((path[1], path[2]), path)
            paths = list(merged.values())
            if self.budget >= 1 and len(paths) > self.budget:
                paths = sorted(paths, key=lambda p: (-p[1], -p[3], p[0]))[: self.budget]
            result.most_active = max(result.most_active, len(paths))
            step += 1
            if step % STALL_WINDOW == 0:
                furthest = max((p[1] for p in paths), default=n)
                if paths and furthest <= reached and furthest < n:
                    result.stalled = True
                    break
                reached = furthest

        def types_of(k: int) -> tuple[str, ...]:
            out = []
            while k:
                k, name = parents[k]
                out.append(name)
            return tuple(reversed(out))

        result.completed = n == 0 or bool(done)
        result.paths = [(p[0], where.byte(p[1]), p[3], p[1] >= n, types_of(p[2])) for p in [*done, *paths, *dead]]
        return result
