"""The two phases of a regex pattern's scan, over a column of patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.unicode_tables import normalize_name

FLAGS = "imsxuUADSJ"
# The constructs of a pattern, in the order in which they are tried.
CONSTRUCTS = [
    ("LiteralText", r"\\Q[\s\S]*?\\E"),
    ("UnicodeProperty", r"\\[pP]\{[^}]*\}"),
    ("EscapeSequence", r"\\[\s\S]"),
    ("CharacterClass", r"\[(?:[^\]\\]|\\[\s\S])*\]"),
    ("RegexComment", r"\(\?#[^()]*(?:\([^()]*\)[^()]*)*\)"),
    ("InlineModifier", rf"\(\?[{FLAGS}]+\)"),
    ("SpecialGroup", r"\(\?(?:[^)]*\))?"),
    ("GroupStart", r"\("),
    ("GroupEnd", r"\)"),
    ("LazyQuantifier", r"[*+?]\?"),
    ("Quantifier", r"[*+?]"),
    ("Alternation", r"\|"),
    ("StartAnchor", r"\^"),
    ("EndAnchor", r"\$"),
    ("AnyChar", r"\."),
    ("Invalid", r"[\\\[]"),
    ("Literal", r"[\s\S]"),
]
_ALL = "|".join(p for _, p in CONSTRUCTS)


def is_inline_modifier(text: Column) -> Column:
    return text.rlike(rf"^\(\?[{FLAGS}]+\)$")


def _kind(text: Column) -> Column:
    out = F.lit("Literal")
    for name, pattern in reversed(CONSTRUCTS[:-1]):
        out = F.when(text.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def scan(patterns: DataFrame, id_col: str, pattern_col: str) -> DataFrame:
    """id, seq, type, text, start (byte), alternatives, ok: the tokens of phase 1.

    A character beyond ASCII is a Literal for each of its bytes. \\x has alternatives: a two-digit escape, and a longer
    one, where enough of the pattern follows. ok is false for the construct at which the scan of a pattern fails.
    """
    parts = F.regexp_extract_all(F.col(pattern_col), F.lit(_ALL), F.lit(0))
    starts = F.aggregate(F.transform(parts, F.octet_length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rows = patterns.select(F.col(id_col), F.col(pattern_col).alias("__p"), F.posexplode(F.arrays_zip(parts.alias("text"), F.slice(starts, F.lit(1), F.size(parts)).alias("start"))).alias("seq", "__x"))
    rows = rows.select(id_col, "__p", "seq", F.col("__x.text").alias("text"), F.col("__x.start").alias("start")).withColumn("type", _kind(F.col("text")))
    rest = F.expr("decode(substring(encode(__p, 'UTF-8'), start + 1), 'UTF-8')")
    long = F.regexp_extract(rest, r"^\\x\{[0-9A-Fa-f]+\}|^\\x[0-9A-Fa-f]{1,4}", 0)
    options = F.when((F.col("text") == "\\x") & (F.octet_length(rest) >= 4), F.array(F.struct(F.lit("HexEscape").alias("type"), F.substring(rest, 1, 4).alias("text")), F.struct(F.lit("UnicodeEscape").alias("type"), F.substring(F.when(F.length(long) > 0, long).otherwise(rest), 1, 6).alias("text"))))
    rows = rows.withColumn("alternatives", F.coalesce(options, F.array().cast("array<struct<type:string,text:string>>")))
    copies = F.when(F.col("type") == "Literal", F.octet_length("text")).otherwise(1)
    rows = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), copies - 1)))
    return rows.select(id_col, "seq", "type", "text", (F.col("start") + F.col("__b")).alias("start"), "alternatives", (F.col("type") != "Invalid").alias("ok"))


def disambiguate(tokens: DataFrame) -> DataFrame:
    """Phase 2: an ambiguous token becomes its longest alternative (the later of equals), property names are checked."""
    best = F.array_max(F.transform("alternatives", lambda a, i: F.struct(F.octet_length(a["text"]).alias("n"), i.alias("i"), a["type"].alias("type"), a["text"].alias("text"))))
    some = F.size("alternatives") > 0
    names = F.regexp_extract("text", r"^\\[pP]\{([^}]*)\}$", 1)

    known = _known_names()
    key = F.lower(F.regexp_replace(names, r"[_\- ]", ""))
    valid = key.isin(*known) | (key.rlike("^(is|in).") & F.substring(key, 3, 1000).isin(*known))
    return tokens.withColumn("valid", F.when(F.col("type") == "UnicodeProperty", valid).otherwise(F.col("ok"))).withColumn("text", F.when(some, best["text"]).otherwise(F.col("text"))).withColumn("type", F.when(some, best["type"]).otherwise(F.col("type")))


def _known_names() -> list[str]:
    from glyphflow.functions.unicode_tables import _names

    return sorted(_names())


def results(tokens: DataFrame, id_col: str) -> DataFrame:
    """Per pattern: tokens, ambiguous ones, their share, bytes, success, and the token types as lines of text."""
    ambiguous = F.sum((F.size("alternatives") > 0).cast("int"))
    line = F.concat(F.col("type"), F.lit(" "), F.col("text"))
    return tokens.groupBy(id_col).agg(
        F.count("*").alias("n_tokens"),
        ambiguous.cast("long").alias("n_ambiguous"),
        (ambiguous / F.count("*")).alias("ambiguity_ratio"),
        F.bool_and("ok").alias("ok"),
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))), lambda x: x["line"])).alias("hierarchy"),
    )


def scan_text(pattern: str) -> list[tuple[str, str]]:
    """Phase 1 of a single pattern, on the driver."""
    out = []
    for m in re.finditer(_ALL, pattern):
        kind = next(n for n, p in CONSTRUCTS if re.fullmatch(p, m.group()))
        out += [(kind, m.group())] * (len(m.group().encode()) if kind == "Literal" else 1)
    return out


def property_is_known(name: str) -> bool:
    return normalize_name(name) is not None
