"""Edit sessions: a text, its tokens, and what an edit leaves of them. One state machine serves batch and stream."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.glr import Forest, Parser, ParseResult, _Run
from glyphflow.grammar.model import Grammar
from glyphflow.lexer import Lexer, Token
from glyphflow.rules import CompiledRule

# Tokens that must agree before the old tail is taken over, checkpoints kept, and how many times its own
# nodes a session's parses may write before the next begins anew.
REALIGN, CHECKPOINTS, RETAINED = 8, 256, 8


@dataclass
class Session:
    """Offsets of edits count characters; token spans here are characters too and become bytes when they leave."""

    text: str = ""
    tokens: list[Token] = field(default_factory=list)
    #: Character where lexing stopped short, or -1.
    unmatched: int = -1
    version: int = 0
    metrics: dict = field(default_factory=dict)
    pending: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Impact:
    first_token: int
    boundary: int
    delta: int


def edit_impact(tokens: list[Token], offset: int, delete: int, insert: str) -> Impact:
    """The first token that an edit can change: the one that touches the offset, or follows it."""
    starts = [t.start for t in tokens]
    first = max(0, bisect_right(starts, offset) - 1)
    # A token that ends at the offset may grow, and one before it may have looked that far.
    while first > 0 and tokens[first - 1].end >= offset:
        first -= 1
    boundary = min(tokens[first].start, offset) if tokens else 0
    return Impact(first, boundary, len(insert) - delete)


class _Characters(Lexer):
    """The lexer with spans in characters."""

    def run(self, text: str, start: int, stop=None) -> tuple[list[Token], int, int]:
        out, at, n = [], start, len(text)
        while at < n:
            found = self.matches(text, at)
            if not found:
                return out, at, at
            rule, end = max(found, key=lambda x: (x[1], -x[0]))
            if not self.rules[rule].skippable:
                out.append(Token(self.retype[rule], text[at:end], at, end))
                if stop is not None and stop(out):
                    return out, end, -1
            at = end
        return out, at, -1


def open_session(lexer: _Characters, text: str) -> Session:
    tokens, _, unmatched = lexer.run(text, 0)
    s = Session(text, tokens, unmatched)
    s.metrics = {"relexed_tokens": len(tokens), "reused_tokens": 0, "resume_boundary": 0, "first_token": 0}
    return s


def apply_edit(lexer: _Characters, s: Session, offset: int, delete: int, insert: str) -> Session:
    """The session after an edit. Tokens before the edit stay; from the first that it may change on, the text is lexed
    anew until REALIGN tokens in a row agree with shifted old ones; then the old tail is taken over."""
    if offset < 0 or delete < 0 or offset + delete > len(s.text):
        raise ValueError(f"edit at {offset}, {delete} lies outside a text of {len(s.text)} characters")
    text = s.text[:offset] + insert + s.text[offset + delete :]
    impact = edit_impact(s.tokens, offset, delete, insert)
    head = s.tokens[: impact.first_token]
    start = head[-1].end if head else 0
    old = {(t.start + impact.delta, t.end + impact.delta, t.type): i for i, t in enumerate(s.tokens) if t.start >= offset + delete}
    agreed, last = 0, -2

    def stop(found: list[Token]) -> bool:
        nonlocal agreed, last
        t = found[-1]
        i = old.get((t.start, t.end, t.type), -1) if t.start >= offset + len(insert) else -1
        agreed = agreed + 1 if i >= 0 and (i == last + 1 or not agreed) else int(i >= 0)
        last = i
        return agreed >= REALIGN

    fresh, end, unmatched = lexer.run(text, start, stop)
    tail: list[Token] = []
    if agreed >= REALIGN:
        tail = [Token(t.type, t.value, t.start + impact.delta, t.end + impact.delta) for t in s.tokens[last + 1 :]]
        unmatched = s.unmatched + impact.delta if s.unmatched >= 0 else -1
        # What was taken over to find the alignment counts as reused.
        tail = fresh[len(fresh) - REALIGN :] + tail
        fresh = fresh[: len(fresh) - REALIGN]
    out = Session(text, head + fresh + tail, unmatched, s.version + 1, pending=s.pending)
    out.metrics = {"relexed_tokens": len(fresh), "reused_tokens": len(head) + len(tail), "resume_boundary": impact.boundary, "first_token": len(head)}
    return out


METRICS = "session_id string, version int, n_chars int, n_tokens int, relexed_tokens int, reused_tokens int, reuse_ratio double, resume_boundary int, consumed_all boolean, unmatched_offset int, text string"

PARSES = "success_full boolean, success_prefix boolean, n_parses int, n_nodes int, resumed_token int"


def _metric_row(key: str, s: Session) -> tuple:
    total = s.metrics["relexed_tokens"] + s.metrics["reused_tokens"]
    byte = len(s.text[: s.unmatched].encode("utf-8", "surrogatepass")) if s.unmatched >= 0 else -1
    return (key, s.version, len(s.text), len(s.tokens), s.metrics["relexed_tokens"], s.metrics["reused_tokens"], s.metrics["reused_tokens"] / total if total else 0.0, s.metrics["resume_boundary"], s.unmatched < 0, byte, s.text)


def _feed(lexer: _Characters, s: Session | None, row: tuple) -> list[Session]:
    """States after a record and any that waited for it. Version 0 opens a session with its inserted text; a version
    beyond the next waits, one that has been is left out, and an edit that doesn't fit changes only the version."""
    version, offset, delete, insert = row
    if s is None:
        s = Session(version=-1)
    if version <= s.version:
        return []
    s.pending[version] = (offset, delete, insert)
    out = []
    while s.version + 1 in s.pending:
        waiting = s.pending
        offset, delete, insert = waiting.pop(s.version + 1)
        if s.version < 0:
            s = open_session(lexer, insert)
        else:
            try:
                s = apply_edit(lexer, s, offset, delete, insert)
            except ValueError:
                s.version += 1
                s.metrics = {"relexed_tokens": 0, "reused_tokens": len(s.tokens), "resume_boundary": -1}
        s.pending = waiting
        out.append(s)
        s = Session(s.text, s.tokens, s.unmatched, s.version, s.metrics, s.pending)
    return out or [s]


def fold(edits: DataFrame, rules: list[CompiledRule], grammar: Grammar | None = None) -> DataFrame:
    """METRICS rows, one for each applied version, of edits (session_id, version, offset, delete_length, insert_text).

    Sessions are sorted within their partition and fed one record at a time, so only one session's text is held. With a
    grammar each version is parsed as well, from the last checkpoint that its edit leaves, and PARSES columns follow;
    resumed_token is where that was.
    """
    ordered = edits.select(F.col("session_id").cast("string"), F.col("version").cast("int"), F.col("offset").cast("int"), F.col("delete_length").cast("int"), F.coalesce("insert_text", F.lit("")).alias("insert_text")).repartition("session_id").sortWithinPartitions("session_id", "version")
    columns = METRICS if grammar is None else f"{METRICS}, {PARSES}"
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = [pa.string(), *[pa.int32()] * 5, pa.float64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int32()] * 3][: len(names)]

    def run(batches):
        lexer = _Characters(rules)
        parser = None if grammar is None else Parser(grammar)
        key, state, parses = None, None, None
        for batch in batches:
            rows = []
            for k, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    key, state, parses = k, None, parser and SessionParser(parser)
                before = -1 if state is None else state.version
                for s in _feed(lexer, state, tuple(row)):
                    state = s
                    if s.version > before:
                        rows.append(_metric_row(k, s) + (_parse_row(parses, s) if parses else ()))
            told = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(told, kinds, strict=True)], names)

    return ordered.mapInArrow(run, columns)


def stream(edits: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """The fold over a stream of edits, with each session's text and tokens as keyed state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [x.split()[0] for x in METRICS.split(", ")]
    lexers: dict[int, _Characters] = {}

    def run(key, frames, state: GroupState):
        lexer = lexers.setdefault(0, _Characters(rules))
        s = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("version")
        out = []
        for r in rows.itertuples(index=False):
            before = -1 if s is None else s.version
            for s in _feed(lexer, s, (int(r.version), int(r.offset), int(r.delete_length), r.insert_text or "")):
                if s.version > before:
                    out.append(_metric_row(key[0], s))
        state.update((pickle.dumps(s),))
        yield pd.DataFrame(out, columns=names)

    typed = edits.select(F.col("session_id").cast("string"), "version", "offset", "delete_length", "insert_text")
    return typed.groupBy("session_id").applyInPandasWithState(run, METRICS, "state binary", "append", GroupStateTimeout.NoTimeout)


class ParseCheckpoints:
    """Parser states by token boundary; when full, every second one of the older half goes."""

    def __init__(self, capacity: int = CHECKPOINTS):
        self.capacity = capacity
        self.at: list[int] = []
        self.states: dict[int, object] = {}

    def store(self, boundary: int, state) -> None:
        if boundary not in self.states:
            self.at.insert(bisect_right(self.at, boundary), boundary)
        self.states[boundary] = state
        if len(self.at) > self.capacity:
            half = len(self.at) // 2
            for b in self.at[1:half:2]:
                del self.states[b]
            self.at = [b for b in self.at if b in self.states]

    def nearest(self, boundary: int) -> tuple[int, object] | None:
        i = bisect_right(self.at, boundary) - 1
        return (self.at[i], self.states[self.at[i]]) if i >= 0 else None

    def invalidate_from(self, boundary: int) -> None:
        for b in [x for x in self.at if x >= boundary]:
            del self.states[b]
        self.at = [b for b in self.at if b in self.states]


class _Reading:
    """A session's forest under one way of reducing, and its checkpoints by token."""

    def __init__(self):
        self.forest, self.checkpoints, self.written = Forest(), ParseCheckpoints(), 0


class SessionParser:
    """The parses of one session's versions, each equal to a cold parse of its tokens.

    Before every token the live paths, the complete parses that rest behind them and the forest's size are checkpointed.
    After edited(first), where first is the first token that an edit may have changed, a parse resumes at the nearest
    checkpoint at or before it. Once the parses since the last cold one have written RETAINED times the nodes of the
    forest, the checkpoints go and the next parse is cold. A pruner looks at the number of all tokens, so with one every
    parse is cold.
    """

    def __init__(self, parser: Parser):
        self.parser = parser
        self.readings = {by_next: _Reading() for by_next in ((True,) if parser.prefixes else (True, False))}
        #: Token at which the last parse took up.
        self.resumed = 0

    def edited(self, first: int) -> None:
        for reading in self.readings.values():
            reading.checkpoints.invalidate_from(first + 1)

    def parse(self, tokens: list[Token], source_length: int) -> ParseResult:
        for by_next in self.readings:
            result = self._parse(by_next, tokens, source_length)
            if result.success_full:
                break
        return result

    def _parse(self, by_next: bool, tokens: list[Token], source_length: int) -> ParseResult:
        reading = self.readings[by_next]
        found = None if self.parser.pruner else reading.checkpoints.nearest(len(tokens))
        if found is None:
            reading = self.readings[by_next] = _Reading()
            resume, self.resumed = None, 0
        else:
            self.resumed, (paths, rested, mark, number) = found
            reading.checkpoints.invalidate_from(self.resumed + 1)
            reading.forest.cut(mark)
            resume = (self.resumed, list(paths), reading.forest, number, {}, rested)
        kept = len(reading.forest.nodes) if resume else 0

        def watch(token: int, paths: list, run: _Run) -> None:
            reading.checkpoints.store(token, (tuple(paths), tuple(run.rested), run.forest.mark(), run.next_number))

        run = _Run(self.parser, tokens, source_length, 0, resume, False, by_next, watch)
        reading.forest = run.forest
        reading.written += len(run.forest.nodes) - kept
        if reading.written > RETAINED * len(run.forest.nodes):
            self.readings[by_next] = _Reading()
        return run.result


def _parse_row(parses: SessionParser, s: Session) -> tuple:
    parses.edited(s.metrics.get("first_token", len(s.tokens)))
    r = parses.parse(s.tokens, len(s.text))
    return (r.success_full, r.success_prefix, r.parses, len(r.nodes), parses.resumed)
