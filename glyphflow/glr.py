"""A generalized shift-reduce parser over tokens. No Spark here.

Stacks are shared: a stack is a number that stands for (symbol, what lies below), so equal stacks have equal numbers and
merging paths is a dictionary. For every token each path's closure under reductions is taken first; every state of the
closure may then shift the token, and a state with a single symbol is a complete parse of what came before.

A token is shifted only onto a symbol that some rule lets it follow, and a parse of a prefix never goes on behind a
gap. With ``prefixes`` both are allowed: any token that starts a rule may be shifted anywhere, and parses of prefixes
stay in the beam. That is looser, and a beam may then lose a complete parse to paths that lead nowhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from glyphflow.grammar.model import Grammar, Production
from glyphflow.lexer import Token

# Beams, score factors, step bounds and node types.
PATH_BUDGET, CLOSURE_BUDGET = 10, 32
SHIFT_FACTOR, REDUCE_FACTOR = np.float32(0.95), np.float32(1.1)
TERMINAL, NONTERMINAL, AMBIGUOUS = 100, 200, 300


def step_budget(tokens: int) -> int:
    return 20 * tokens + 64


class Path(NamedTuple):
    stack: int
    position: int
    last_start: int
    score: np.float32
    #: Numbers of this path and those it came from.
    number: int
    #: Index of the last token that was shifted.
    last_token: int
    depth: int


@dataclass
class Node:
    id: int
    type: int
    name: str
    value: str | None
    start: int
    length: int


@dataclass
class ParseResult:
    #: Parses that the forest holds: complete ones if there are any, else those of a prefix.
    parses: int = 0
    #: All paths that rest on one symbol, however much they took.
    resting: int = 0
    success_prefix: bool = False
    success_full: bool = False
    roots: list[int] = field(default_factory=list)
    nodes: list[tuple[Node, int]] = field(default_factory=list)
    packed: list[tuple[int, int, int]] = field(default_factory=list)
    edges: list[tuple[int, int, int, int]] = field(default_factory=list)
    resolved: list[Token] = field(default_factory=list)
    #: Token at which the last path died, if none survived.
    failed_at: int = -1
    steps: int = 0
    snapshots: list[tuple[int, tuple[Path, ...]]] = field(default_factory=list)
    labels: list[tuple[int, list[float], int]] = field(default_factory=list)


class Parser:
    """Reads productions once; each Parser call works on one document."""

    def __init__(self, grammar: Grammar, budget: int = PATH_BUDGET, preconditions: dict[str, Callable] | None = None, actions: dict[str, Callable] | None = None, contexts: tuple[str, ...] = (), pruner=None, prefixes: bool = False):
        """prefixes: resting parses of a prefix stand beside complete ones, under one ambiguous root."""
        ready = grammar.materialized()
        self.rules: list[Production] = ready.productions
        self.roots = ready.root_rules()
        self.ignorable = ready.ignorable()
        self.budget, self.preconditions, self.actions = budget, preconditions or {}, actions or {}
        self.contexts, self.pruner, self.prefixes = set(contexts), pruner, prefixes
        #: Rules by the symbol, or pair of symbols, that a reducible stack ends with.
        self.by_last: dict[str, list[int]] = defaultdict(list)
        self.by_pair: dict[tuple[str, str], list[int]] = defaultdict(list)
        #: For each symbol, the stack tops (nearest first) after which it may be shifted.
        self.before: dict[str, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        #: Symbols that some rule lets follow a symbol directly, what those begin with included.
        self.after: dict[str, set[str]] = defaultdict(set)
        begins = self._begins()
        self.follow = self._follows(begins)
        for r, rule in enumerate(self.rules):
            for left, right in zip(rule.rhs, rule.rhs[1:], strict=False):
                self.after[left] |= begins.get(right, {right})
            if len(rule.rhs) == 1:
                self.by_last[rule.rhs[0]].append(r)
            else:
                self.by_pair[rule.rhs[-2], rule.rhs[-1]].append(r)
            for i, symbol in enumerate(rule.rhs):
                self.before[symbol].append((r, rule.rhs[:i][::-1]))

    def _follows(self, begins: dict[str, set[str]]) -> dict[str, set[str]]:
        """For each symbol, what may stand after it in some parse."""
        follow: dict[str, set[str]] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for rule in self.rules:
                for i, symbol in enumerate(rule.rhs):
                    more = begins.get(rule.rhs[i + 1], {rule.rhs[i + 1]}) if i + 1 < len(rule.rhs) else follow[rule.name]
                    if not more <= follow[symbol]:
                        follow[symbol] |= more
                        changed = True
        return follow

    def _begins(self) -> dict[str, set[str]]:
        """For each rule name, itself and every symbol that may stand first in it."""
        first: dict[str, set[str]] = defaultdict(set)
        for rule in self.rules:
            first[rule.name] |= {rule.name, rule.rhs[0]}
        changed = True
        while changed:
            changed = False
            for own in first.values():
                more = set().union(*(first[s] for s in own if s in first)) - own
                own |= more
                changed |= bool(more)
        return first

    def __call__(self, tokens: list[Token], source_length: int, snapshot_every: int = 0, resume: tuple | None = None, label: bool = False) -> ParseResult:
        run = _Run(self, tokens, source_length, snapshot_every, resume, label)
        if not run.result.success_full and not self.prefixes:
            # The longest parse of a prefix needs reductions that the next token speaks against.
            run = _Run(self, tokens, source_length, snapshot_every, resume, label, by_next=False)
        return run.result


class Forest:
    """Interned stacks and the nodes written so far; shared by a document's parses."""

    def __init__(self):
        # stack -> (symbol, node, stack below, depth); 0 is the empty stack.
        self.stacks: list[tuple[str, int, int, int]] = [("", -1, 0, 0)]
        self.numbers: dict[tuple[str, int, int, int], int] = {}
        self.nodes: list[Node] = []
        self.children: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
        self.shifted: dict[tuple[int, str], int] = {}
        self.reduced: dict[tuple[int, int], int] = {}
        self.packed = 0

    def push(self, symbol: str, node: int, below: int) -> int:
        # Derivations of one symbol over one span share a stack; the first stands for them.
        key = (symbol, self.nodes[node].start, self.nodes[node].length, below)
        if key not in self.numbers:
            self.numbers[key] = len(self.stacks)
            self.stacks.append((symbol, node, below, self.stacks[below][3] + 1))
        return self.numbers[key]

    def mark(self) -> tuple[int, int, int]:
        return len(self.stacks), len(self.nodes), self.packed

    def cut(self, mark: tuple[int, int, int]) -> None:
        """Back to what there was at the mark; takes as long as what came after is large."""
        stacks, nodes, self.packed = mark
        for numbers, bound in ((self.numbers, stacks), (self.shifted, nodes), (self.reduced, nodes)):
            # Entries lie in the order of their numbers.
            while numbers and next(reversed(numbers.values())) >= bound:
                numbers.popitem()
        for n in range(nodes, len(self.nodes)):
            self.children.pop(n, None)
        del self.stacks[stacks:], self.nodes[nodes:]

    def node(self, kind: int, name: str, value: str | None, start: int, length: int) -> int:
        self.nodes.append(Node(len(self.nodes), kind, name, value, start, length))
        return len(self.nodes) - 1


class _Run:
    def __init__(self, parser: Parser, tokens: list[Token], source_length: int, snapshot_every: int, resume, label: bool, by_next: bool = True, watch: Callable | None = None):
        """by_next: reduce only to what the next token may follow. watch(token, paths, run) is called before each token."""
        self.by_next = by_next and not parser.prefixes
        self.p, self.tokens, self.label = parser, tokens, label
        self.result = ParseResult()
        self.next_number = 1
        self.rested: list[Path] = []
        self.forest = Forest()
        paths = [Path(0, 0, -1, np.float32(1), 0, -1, 0)]
        self.lineage: dict[int, int] = {0: -1}
        begin = 0
        if resume is not None:
            begin, paths, self.forest, self.next_number, lineage, *rested = resume
            self.lineage = dict(lineage)
            self.rested = list(rested[0]) if rested else []
        significant = [i for i, t in enumerate(tokens) if t.type not in parser.ignorable]
        stacks = self.forest.stacks
        limit = step_budget(len(tokens))
        for k in significant:
            if k < begin:
                continue
            if snapshot_every and k % snapshot_every == 0:
                self.result.snapshots.append((k, tuple(paths)))
            if watch:
                watch(k, paths, self)
            self.result.steps += 1
            if self.result.steps > limit:
                break
            sibling = k + 1 < len(tokens) and tokens[k + 1].start == tokens[k].start
            onward: list[Path] = []
            for path in paths:
                onward += self._advance(path, k, sibling)
            paths = self._merged(onward)
            if label and len(paths) > PATH_BUDGET:
                self._label(paths)
            if parser.pruner is not None:
                paths = parser.pruner(paths, len(tokens))
            paths = self._beam(paths, parser.budget)
            if not parser.prefixes:
                self.rested = self._merged([p for p in self.rested if p.position >= max(x.position for x in self.rested)])
            if not paths:
                self.result.failed_at = k
                break
        paths = self._finish(paths)
        if not any(p.depth == 1 for p in paths):
            paths = self._finish(self.rested)
        self.final = paths
        found = [p for p in paths if p.depth == 1]
        self.result.resting, self.result.success_prefix = len(found), bool(found)
        complete = [p for p in found if tokens[p.last_token].start >= tokens[significant[-1]].start]
        self.result.success_full = bool(complete)
        found = complete if complete and not parser.prefixes else found
        self.result.parses = len(found)
        if found:
            roots = [stacks[p.stack][1] for p in found]
            root = roots[0] if len(roots) == 1 else self._ambiguous(roots, source_length)
            self._collect(root)
            self._resolve(root if len(roots) == 1 else roots[0])
        if label:
            alive = set()
            for p in found:
                n = p.number
                while n >= 0 and n not in alive:
                    alive.add(n)
                    n = self.lineage.get(n, -1)
            self.result.labels = [(n, f, int(n in alive)) for n, f, _ in self.result.labels]

    def _allowed(self, rule: Production, context: str) -> bool:
        if rule.context and rule.context != context and rule.context not in self.p.contexts:
            return False
        check = self.p.preconditions.get(rule.name)
        return check is None or bool(check(rule, context))

    def _top(self, stack: int, symbols: tuple[str, ...]) -> bool:
        stacks = self.forest.stacks
        for s in symbols:
            if stack == 0 or stacks[stack][0] != s:
                return False
            stack = stacks[stack][2]
        return True

    def _covered(self, path: Path, t: Token) -> bool:
        """Whether the path has taken another reading of the token's span."""
        if self.p.prefixes or path.last_token < 0:
            return t.start <= path.last_start
        return t.start < self.tokens[path.last_token].end

    def _fork(self, path: Path, **change) -> Path:
        number = self.next_number
        self.next_number += 1
        self.lineage[number] = path.number
        return path._replace(number=number, **change)

    def _shift(self, path: Path, k: int) -> Path | None:
        t = self.tokens[k]
        if self._covered(path, t):
            return None
        if path.stack and not self.p.prefixes and t.type not in self.p.after[self.forest.stacks[path.stack][0]]:
            return None
        for r, before in self.p.before.get(t.type, ()):
            if self._top(path.stack, before) and self._allowed(self.p.rules[r], t.context):
                break
        else:
            return None
        f = self.forest
        key = (t.start, t.type, t.end)
        if key not in f.shifted:
            f.shifted[key] = f.node(TERMINAL, t.type, t.value, t.start, t.end - t.start)
        stack = f.push(t.type, f.shifted[key], path.stack)
        return self._fork(path, stack=stack, position=path.position + 1, last_start=t.start, score=path.score * SHIFT_FACTOR, last_token=k, depth=path.depth + 1)

    def _reductions(self, path: Path, context: str, next_type: str | None) -> list[Path]:
        """What the path's top reduces to; next_type is None at the end of input."""
        stacks = self.forest.stacks
        if not path.stack:
            return []
        top, _, below, depth = stacks[path.stack]
        tried = list(self.p.by_last.get(top, ()))
        if below:
            tried += self.p.by_pair.get((stacks[below][0], top), ())
        out = []
        for r in sorted(tried):
            rule = self.p.rules[r]
            if len(rule.rhs) > depth:
                continue
            if rule.name in self.p.roots:
                # A root is nothing's part, so it stands for the whole stack or leads nowhere.
                if next_type is not None or (len(rule.rhs) < depth and not self.p.prefixes):
                    continue
            elif self.by_next and next_type is not None and next_type not in self.p.follow[rule.name]:
                continue
            if self._top(path.stack, rule.rhs[::-1]) and self._allowed(rule, context):
                out.append(self._reduce(path, r))
        return out

    def _reduce(self, path: Path, r: int) -> Path:
        f, rule = self.forest, self.p.rules[r]
        children, stack = [], path.stack
        for _ in rule.rhs:
            _, node, stack, _ = f.stacks[stack]
            children.append(node)
        children.reverse()
        key = (path.stack, r)
        if key not in f.reduced:
            first, last = f.nodes[children[0]], f.nodes[children[-1]]
            value = None
            if action := self.p.actions.get(rule.name):
                try:
                    value = action(rule, [f.nodes[c] for c in children])
                except Exception:  # noqa: BLE001  an action's failure leaves the node without a value
                    value = None
            elif rule.action.startswith("$") and rule.action[1:].rstrip(";").isdigit() and 0 < int(rule.action[1:].rstrip(";")) <= len(children):
                value = f.nodes[children[int(rule.action[1:].rstrip(";")) - 1]].value
            node = f.node(NONTERMINAL, rule.name, value, first.start, last.start + last.length - first.start)
            f.children[node].append((f.packed, r, children))
            f.packed += 1
            f.reduced[key] = node
        return self._fork(path, stack=f.push(rule.name, f.reduced[key], stack), score=path.score * REDUCE_FACTOR, depth=path.depth - len(rule.rhs) + 1)

    def _advance(self, path: Path, k: int, sibling: bool) -> list[Path]:
        t = self.tokens[k]
        seen, wave, out = {path.stack}, [path], []
        for _ in range(2 * len(self.tokens) + 16):
            reduced: list[Path] = []
            for state in wave:
                shifted, less = self._shift(state, k), self._reductions(state, t.context, t.type)
                reduced += less
                if shifted:
                    out.append(shifted)
                if state.depth == 1:
                    # A complete parse of what came before.
                    (out if self.p.prefixes else self.rested).append(state)
                if state.depth == 1 and self.p.prefixes:
                    continue
                if sibling and not self.p.prefixes:
                    out.append(state)  # it may take another reading, which follows
                elif not shifted and not less and (self._covered(state, t) or sibling):
                    out.append(state)
            wave = [s for s in self._merged(reduced) if s.stack not in seen]
            seen.update(s.stack for s in wave)
            if not wave:
                break
            wave = sorted(wave, key=lambda s: (-s.position, -s.score))[:CLOSURE_BUDGET]
        return out

    def _merged(self, paths: list[Path]) -> list[Path]:
        best: dict[tuple[int, int], Path] = {}
        for p in paths:
            key = (p.position, p.stack)
            if key not in best or p.score > best[key].score:
                best[key] = p
        return list(best.values())

    def _beam(self, paths: list[Path], budget: int) -> list[Path]:
        if budget < 1 or len(paths) <= budget:
            return paths
        ranked = sorted(paths, key=lambda p: (-p.position, -p.score))
        kept, best = ranked[:budget], max(paths, key=lambda p: p.score)
        return kept if best in kept else [*kept[:-1], best]

    def _finish(self, paths: list[Path]) -> list[Path]:
        context = self.tokens[-1].context if self.tokens else ""
        seen: set[tuple[int, int]] = set()
        for _ in range(2 * len(self.tokens) + 16):
            onward, moved = [], False
            for p in paths:
                key = (p.position, p.stack)
                less = [] if key in seen else self._reductions(p, context, None)
                seen.add(key)
                onward += less or [p]
                moved |= bool(less)
            paths = self._merged(onward)
            if not moved:
                break
            if self.p.budget >= 1 and len(paths) > self.p.budget:
                paths = sorted(paths, key=lambda p: (0 if self.p.prefixes else -p.position, -p.score))[: self.p.budget]
        return paths

    def _ambiguous(self, roots: list[int], source_length: int) -> int:
        f = self.forest
        node = f.node(AMBIGUOUS, "AmbiguousRoot", None, 0, source_length)
        for i, root in enumerate(roots):
            f.children[node].append((f.packed, i + 1, [root]))
            f.packed += 1
        return node

    def _collect(self, root: int) -> None:
        """The nodes reachable from the root with their distance, and their edges."""
        f, r = self.forest, self.result
        r.roots = [root]
        depth, queue = {root: 0}, [root]
        for n in queue:
            r.nodes.append((f.nodes[n], depth[n]))
            for packed, rule, children in f.children.get(n, ()):
                r.packed.append((packed, n, rule))
                for i, c in enumerate(children):
                    r.edges.append((packed, n, c, i))
                    if c not in depth:
                        depth[c] = depth[n] + 1
                        queue.append(c)

    def _resolve(self, root: int) -> None:
        """The tokens under the first parse."""
        f, leaves, stack = self.forest, set(), [root]
        seen = set()
        while stack:
            n = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            node = f.nodes[n]
            if node.type == TERMINAL:
                leaves.add((node.start, node.name, node.start + node.length))
            for _, _, children in f.children.get(n, ()):
                stack += children
        by_key = {(t.start, t.type, t.end): t for t in self.tokens}
        self.result.resolved = [by_key[k] for k in sorted(leaves) if k in by_key]

    def _label(self, paths: list[Path]) -> None:
        from glyphflow.ml.features import path_features

        best, deepest = max(float(p.score) for p in paths), max(p.position for p in paths)
        for p in paths:
            self.result.labels.append((p.number, path_features(float(p.score), p.position, p.last_start, p.number, best, deepest, len(self.tokens)), 0))
