"""Documents to tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphflow.functions.unicode_tables import Ranges
from glyphflow.grammar import Grammar
from glyphflow.lexer import PATH_BUDGET, Lexer, Positions, split_escapes
from glyphflow.plans.lexing import NativeLexer, native_lexer
from glyphflow.rules import CompiledRule, char_class

UNMATCHED = "\x00"
TOKEN_SCHEMA = "step int, path_id int, seq int, type string, value string, start_pos int, length int, line int, start_col int, end_col int, context string, is_splittable boolean, split_tokens array<struct<type string, value string>>"
STATUS_SCHEMA = "completed boolean, unmatched int, stalled boolean, consumed int, n_tokens int, n_paths int, most_active int, attempts long, wasted long"


def _rules(rules: Grammar | list[CompiledRule]) -> list[CompiledRule]:
    return rules.lexer_rules() if isinstance(rules, Grammar) else sorted(rules, key=lambda r: (-r.priority, r.ordinal))


def _starts_in(value: Column, ranges: Ranges) -> Column:
    """Whether the first character is in the ranges: comparisons for a few, a pattern for many."""
    if len(ranges) > 12:
        return value.rlike("^" + char_class(ranges))
    point, out = F.ascii(value), F.lit(False)
    for a, b in ranges:
        out = out | (point == a if a == b else point.between(a, b))
    return out


def _type_of(native: NativeLexer, value: Column) -> Column:
    out = F.lit(UNMATCHED)
    for ranges, name, _ in reversed(native.classes):
        out = F.when(_starts_in(value, ranges), F.lit(name)).otherwise(out)
    for literal, name, _ in reversed(native.literals):
        out = F.when(value == F.lit(literal), F.lit(name)).otherwise(out)
    return out


def token_array(native: NativeLexer, text: Column) -> Column:
    """array<struct<value, type>> up to the first character that no rule takes, skippable tokens included."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(native.pattern), F.lit(0)), lambda v: F.struct(v.alias("value"), _type_of(native, v).alias("type")))
    return pairs


def _cut(tokens: Column) -> Column:
    stop = F.array_position(F.transform(tokens, lambda t: t["type"]), UNMATCHED)
    return F.when(stop > 0, F.slice(tokens, F.lit(1), (stop - 1).cast("int"))).otherwise(tokens)


def _rest(native: NativeLexer, text: Column) -> Column:
    """What stands from the first character on that no rule takes: matches that follow one another are taken off."""
    return F.regexp_replace(text, F.lit(rf"\G(?:{native.rules})"), F.lit(""))


def token_values(native: NativeLexer, text: Column) -> Column:
    """array<string> of the tokens up to the first character that no rule takes, skippable ones included."""
    taken = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(_rest(native, text)))
    return F.regexp_extract_all(taken, F.lit(native.rules), F.lit(0))


_PLACES = ["seq", "value", "length", "start_pos", "line", "start_col", "end_col"]
#: Tokens that are placed at a time, and those of a row on the way to Python.
PLACED, CARRIED = 1 << 16, 64


def _rows(batches):
    """Ids, seq and value of tokens, at most PLACED at a time but for a longer list, out of rows of id, the seq of the
    first (0 where that column isn't there) and the values."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = batch.column(1).to_numpy() if batch.num_columns == 3 else np.zeros(len(size), np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACED, "right")))
            own = size[at:to]
            row = np.repeat(np.arange(to - at), own)
            seq = np.arange(len(row)) + (begin[at:to] - np.cumsum(own) + own)[row]
            yield batch.select([0]).slice(at, to - at).take(pa.array(row)), seq, lists.slice(at, to - at).flatten()
            at = to


def _place(batches, only: list[str] | None = None):
    """Tokens with their places, in whole arrays. Rows come in a document's order; it may go on in the next batch.

    only: the values of the tokens that are given out, None for all.
    """
    # Of the document that goes on: its bytes so far, the line and the byte at which that begins.
    at, on, begun = 0, 1, 0
    for ids, seq, value in _rows(batches):
        if not len(seq):
            continue
        length = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
        end = at + np.cumsum(length)
        start = end - length
        first = np.maximum.accumulate(np.where(seq == 0, np.arange(len(seq)), -1))
        base = np.where(first < 0, 0, start[first])
        breaks = pc.count_substring(value, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        lines = on + np.cumsum(breaks) - breaks
        line = lines - np.where(first < 0, 0, lines[first] - 1)
        # The byte behind the last newline so far; a document begins anew.
        broken = np.flatnonzero(breaks)
        tail = pc.binary_length(pc.replace_substring_regex(value.take(pa.array(broken)), "(?s)^.*\n", "")).to_numpy(zero_copy_only=False).astype(np.int64)
        behind = np.zeros(len(end) + 1, np.int64)
        behind[0] = begun
        behind[broken + 1] = end[broken] - tail
        behind = np.maximum.accumulate(behind)
        column = start - np.maximum(behind[:-1], base) + 1
        at, on, begun = int(end[-1] - base[-1]), int(line[-1] + breaks[-1]), int(max(behind[-1], base[-1]) - base[-1])
        named, places = ids.column(0), (seq, length, start - base, line, column, column + length)
        if only is not None:
            wanted = np.flatnonzero(pc.is_in(value, pa.array(only, value.type)).to_numpy(zero_copy_only=False))
            if not len(wanted):
                continue
            named, value = (x.take(pa.array(wanted)) for x in (named, value))
            places = tuple(c[wanted] for c in places)
        told = [pa.array(c.astype(np.int32)) for c in places]
        yield pa.record_batch([named, told[0], value, *told[1:]], [ids.schema.names[0], *_PLACES])


def native_tokens(docs: DataFrame, native: NativeLexer, id_col: str, text_col: str, positions: bool = False, only: list[str] | None = None) -> DataFrame:
    """id, seq (in the document, skippable ones counted), type, value, and with positions start_pos, length, line,
    start_col and end_col; skippable tokens are left out, and where only is given those of other values.

    Nothing is shuffled. Positions are sums along a document's own tokens, taken in Arrow batches.
    """
    if only and all(map(str.isascii, only)):
        # A text without any of them has no such token. (Others could come of bytes that aren't UTF-8.)
        docs = docs.where(reduce(or_, [F.contains(F.col(text_col), F.lit(x)) for x in only]))
    skip = [n for _, n, s in (*native.literals, *native.classes) if s]
    keep = ~F.col("type").isin(skip) if skip else F.lit(True)
    values = docs.select(F.col(id_col), token_values(native, F.col(text_col)).alias("__v"))
    if positions:
        kinds = StructType([values.schema[0], *StructType.fromDDL(", ".join(f"{c} {'string' if c == 'value' else 'int'}" for c in _PLACES)).fields])
        # A document's values go to Python a few a row: an Arrow batch has thousands of rows, whatever lies in them.
        v = F.col("__v")
        runs = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(CARRIED)), lambda at: F.struct(at.alias("at"), F.slice(v, at + 1, F.lit(CARRIED)).alias("v"))))
        # An outer explode, as Spark would lex each text once more to leave out the empty ones.
        carried = values.select(id_col, F.explode_outer(runs).alias("__r")).where("__r IS NOT NULL")
        rows = carried.select(id_col, "__r.at", "__r.v").mapInArrow(partial(_place, only=only), kinds)
    else:
        rows = values.select(id_col, F.posexplode("__v").alias("seq", "value"))
        rows = rows if only is None else rows.where(F.col("value").isin(only))
    typed = rows.select(id_col, "seq", _type_of(native, F.col("value")).alias("type"), "value", *(_PLACES[2:] if positions else []))
    return typed.where(keep)


def native_status(docs: DataFrame, native: NativeLexer, id_col: str, text_col: str) -> DataFrame:
    """id, consumed (bytes), completed, unmatched (byte of the first character that no rule takes, or -1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col), F.octet_length(text).alias("__n"), F.octet_length(_rest(native, text)).alias("__r"))
    whole, consumed = F.col("__r") == 0, F.col("__n") - F.col("__r")
    return sizes.select(id_col, consumed.alias("consumed"), whole.alias("completed"), F.when(whole, -1).otherwise(consumed).alias("unmatched"))


def _token_rows(found, where: Positions) -> Iterator[tuple]:
    for seq, t in enumerate(found.tokens):
        line, column = where.line_column(t.start)
        parts = [{"type": a, "value": b} for a, b in split_escapes(t.value)]
        yield t.step, t.path, seq, t.type, t.value, t.start, t.end - t.start, line, column, column + t.end - t.start, t.context, bool(parts), parts


#: Rows of the general lexer that are gathered at a time, and documents that are read at a time.
GATHERED, READ = 1 << 12, 64


def _gathered(found: Iterator[tuple]) -> Iterator[tuple]:
    """Ids and columns of (id, row), GATHERED at a time; a document's rows may go on in the next part."""
    while own := list(islice(found, GATHERED)):
        ids, rows = zip(*own, strict=True)
        yield ids, zip(*rows, strict=True)


def _run(docs: DataFrame, rules, id_col: str, text_col: str, mode: str, budget: int, contexts, prioritizer, schema: str, rows_of) -> DataFrame:
    rules = _rules(rules)
    names = [p.split()[0] for p in _fields(schema)]

    def run(batches):
        lexer = Lexer(rules, budget, contexts, prioritizer)
        kinds = [f.type for f in arrow]
        for batch in batches:
            for at in range(0, batch.num_rows, READ):
                part = batch.slice(at, READ)
                found = ((i, row) for i, text in enumerate(part.column(1).to_pylist()) for row in rows_of(*lexed(lexer, text or "")))
                for ids, columns in _gathered(found):
                    yield pa.record_batch([part.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, *names])

    def lexed(lexer, text):
        return lexer.greedy(text) if mode == "greedy" else lexer.explore(text), text

    pair = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([pair.schema[0], *StructType.fromDDL(schema).fields])
    arrow = list(to_arrow_schema(StructType(out.fields[1:])))
    return pair.mapInArrow(run, out)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def general_tokens(docs: DataFrame, rules: Grammar | list[CompiledRule], id_col: str, text_col: str, mode: str = "exploratory", budget: int = PATH_BUDGET, contexts: tuple[str, ...] = ("default",), prioritizer=None) -> DataFrame:
    """id and TOKEN_SCHEMA: the tokens of the general lexer, a bag over paths in step order when exploratory."""
    return _run(docs, rules, id_col, text_col, mode, budget, contexts, prioritizer, TOKEN_SCHEMA, lambda found, text: _token_rows(found, Positions(text)))


def lex_status(docs: DataFrame, rules: Grammar | list[CompiledRule], id_col: str, text_col: str, mode: str = "exploratory", budget: int = PATH_BUDGET, contexts: tuple[str, ...] = ("default",), prioritizer=None) -> DataFrame:
    """id and STATUS_SCHEMA: one row for each document."""

    def rows_of(found, text):
        consumed = max((p[1] for p in found.paths), default=0)
        return [(found.completed, found.unmatched, found.stalled, consumed, len(found.tokens), sum(p[3] for p in found.paths), found.most_active, found.attempts, found.wasted)]

    return _run(docs, rules, id_col, text_col, mode, budget, contexts, prioritizer, STATUS_SCHEMA, rows_of)


def lex_paths(docs: DataFrame, rules, id_col: str, text_col: str, budget: int = PATH_BUDGET) -> DataFrame:
    """id, path_id, position, n_tokens, completed, types: the lexer's paths when it ended."""
    return _run(docs, rules, id_col, text_col, "exploratory", budget, ("default",), None, "path_id int, position int, n_tokens int, completed boolean, types array<string>", lambda found, text: [(a, b, c, d, list(e)) for a, b, c, d, e in found.paths])


def lex(docs: DataFrame, rules: Grammar | list[CompiledRule], id_col: str = "doc_id", text_col: str = "text", mode: str = "greedy", positions: bool = False, budget: int = PATH_BUDGET, only: list[str] | None = None) -> DataFrame:
    """id, seq, type, value (and positions): in the JVM where the rules allow it, else by the general lexer.

    Null text counts as empty and has no token. only: the values of the tokens that are wanted, None for all.
    """
    native = native_lexer(_rules(rules)) if mode == "greedy" else None
    if native is not None:
        return native_tokens(docs, native, id_col, text_col, positions, only)
    found = general_tokens(docs, rules, id_col, text_col, mode, budget)
    found = found if only is None else found.where(F.col("value").isin(only))
    own = [id_col, "seq", "type", "value"]
    return found.select(*own, *(["start_pos", "length", "line", "start_col", "end_col"] if positions else []))


# Table forms of the lexer's and parser's bookkeeping, for tables of paths.


def merge_paths(paths: DataFrame, keys: list[str], first_by: str) -> DataFrame:
    """One path of each key: the first by the given column (map-side combined)."""
    others = [c for c in paths.columns if c not in keys]
    best = paths.groupBy(*keys).agg(F.min(F.struct(first_by, *[c for c in others if c != first_by])).alias("__b"))
    return best.select(*keys, "__b.*").select(*paths.columns)


def prune_paths(paths: DataFrame, doc: str, budget: int) -> DataFrame:
    """The budget's paths of each document by position, then tokens (both falling), then path_id; under 1, all."""
    if budget < 1:
        return paths
    order = Window.partitionBy(doc).orderBy(F.col("position").desc(), F.col("n_tokens").desc(), "path_id")
    return paths.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= budget).drop("__r")


def prune_scored(paths: DataFrame, doc: str, budget: int) -> DataFrame:
    """The budget's paths by position, then score (both falling), the best-scored always among them."""
    by_place = Window.partitionBy(doc).orderBy(F.col("position").desc(), F.col("score").desc(), "path_id")
    by_score = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("position").desc(), "path_id")
    ranked = paths.withColumn("__r", F.row_number().over(by_place)).withColumn("__s", F.row_number().over(by_score))
    # The best-scored path takes the last place when its own place is beyond the budget.
    outside = F.max(F.when(F.col("__s") == 1, (F.col("__r") > budget).cast("int"))).over(Window.partitionBy(doc))
    return ranked.withColumn("__o", outside).where((F.col("__s") == 1) | (F.col("__r") <= budget - F.col("__o"))).drop("__r", "__s", "__o")


def retag(tokens: DataFrame, actions: dict[str, str], type_col: str = "type") -> DataFrame:
    """Token types as the return("X") of their rules' actions says."""
    import re

    named = {k: m[1] for k, v in actions.items() if (m := re.search(r'return\("([^"]+)"\)', v))}
    out = F.col(type_col)
    for k, v in named.items():
        out = F.when(F.col(type_col) == k, F.lit(v)).otherwise(out)
    return tokens.withColumn(type_col, out)


def split_tokens(tokens: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds split_tokens: the bodies of a token's hexadecimal escapes."""
    found = F.regexp_extract_all(F.col(value_col), F.lit(r"\\x\{([^}]+)\}"), F.lit(1))
    return tokens.withColumn("split_tokens", F.transform(found, lambda x: F.struct(F.lit("HEX_ESCAPE").alias("type"), x.alias("value"))))
