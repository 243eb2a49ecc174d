"""Text, encoding and Unicode functions over columns."""

from __future__ import annotations

import codecs
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.unicode_tables import BLOCKS, LAST, SCRIPTS, property_ranges

# Byte-order marks, the longer ones of a beginning first, with their encodings.
MARKS = [("EFBBBF", "UTF-8"), ("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]


def detect_encoding(data: Column) -> Column:
    """struct(encoding, mark_bytes) by the byte-order mark; UTF-8 and 0 without one."""
    out = F.struct(F.lit("UTF-8").alias("encoding"), F.lit(0).alias("mark_bytes"))
    for mark, name in reversed(MARKS):
        n = len(mark) // 2
        out = F.when(F.hex(F.substring(data, 1, n)) == mark, F.struct(F.lit(name).alias("encoding"), F.lit(n).alias("mark_bytes"))).otherwise(out)
    return out


def _codec(name: str) -> str | None:
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def encoding_available(name: str | int) -> bool:
    """Whether an encoding name, or the number of a code page, is known."""
    return (_codec(f"cp{name}") or _codec(f"windows-{name}")) is not None if isinstance(name, int) else _codec(name) is not None


def available_encodings() -> list[str]:
    from encodings.aliases import aliases

    return sorted({n for n in map(_codec, aliases.values()) if n and not n.endswith("_codec") and n not in ("rot13", "hex", "base64", "bz2", "zlib", "uu", "quopri")})


def decode_bytes(data: bytes) -> str:
    """Bytes as text, in the encoding that their byte-order mark names; the mark is left out, malformed parts are U+FFFD."""
    head = data[:4].hex().upper()
    mark, name = next(((m, e) for m, e in MARKS if head.startswith(m)), ("", "UTF-8"))
    return data[len(mark) // 2 :].decode(name, "replace")


def convert(data: Column, encoding: str | int) -> Column:
    """Bytes in a named encoding, or a code page by number, as text; what can't be read becomes U+FFFD.

    UTF-8, ASCII's and Latin-1's bytes are read in the JVM, others in Arrow batches.
    """
    name = _codec(f"cp{encoding}") if isinstance(encoding, int) else _codec(encoding)
    if name is None:
        raise ValueError(f"unknown encoding {encoding}")
    if name == "utf-8":
        return F.make_valid_utf8(data.cast("string"))
    if name == "iso8859-1":
        return F.decode(data, "ISO-8859-1")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode(name, "replace"))

    return run(data)


def decode_with_bom(data: Column) -> Column:
    """Bytes as text, in the encoding that their byte-order mark names; the mark is left out.

    Only marked UTF-16 and UTF-32 leave the JVM.
    """
    found = detect_encoding(data)
    plain = found["encoding"] == "UTF-8"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode_bytes(bytes(b)))

    body = F.substring(data, found["mark_bytes"] + 1, F.octet_length(data))
    return F.when(plain, F.make_valid_utf8(body.cast("string"))).otherwise(run(F.when(~plain, data)))


def normalize(text: Column, form: str = "NFC") -> Column:
    """Unicode normalization; form is NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalization form {form}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize(form, t))

    return run(text)


def canonically_equivalent(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def code_points(text: Column) -> Column:
    """array<int> of the code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def grapheme_starts(text: Column) -> Column:
    """Boundaries as code-point offsets; the simplified rule takes every code point for a cluster."""
    n = F.char_length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def valid_code_points(text: Column, form: str | None = None) -> Column:
    """Whether no code point of the (normalized) text is U+FFFD or a noncharacter."""
    subject = normalize(text, form) if form else text
    ranges = property_ranges("Noncharacter_Code_Point") + ((0xFFFD, 0xFFFD),)
    return ~subject.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def hex_escapes(text: Column) -> Column:
    """array<struct<escape, code_point>> of \\xHH and \\x{H...} (up to six digits)."""
    found = F.regexp_extract_all(text, F.lit(r"(\\x(?:\{[0-9A-Fa-f]{1,6}\}|[0-9A-Fa-f]{2}))"), F.lit(1))
    return F.transform(found, lambda e: F.struct(e.alias("escape"), F.conv(F.regexp_replace(e, r"[\\x{}]", ""), 16, 10).cast("int").alias("code_point")))


def range_table(spark, kind: str) -> DataFrame:
    """name, first, last of the blocks or the scripts."""
    if kind == "block":
        rows = [(n, a, b) for n, (a, b) in BLOCKS.items()]
    else:
        rows = [(n, a, b) for n, flat in SCRIPTS.items() for a, b in zip(flat[::2], flat[1::2], strict=True)]
    return spark.createDataFrame(rows, "name string, first int, last int")


def count_by_range(points: DataFrame, kind: str) -> DataFrame:
    """name, n for rows (code_point, n): the block or script of each code point, those in none left out.

    Code points are few (each once), and the table is fixed, so the range join is a small broadcast.
    """
    ranges = F.broadcast(range_table(points.sparkSession, kind))
    joined = points.join(ranges, F.col("code_point").between(F.col("first"), F.col("last")))
    return joined.groupBy("name").agg(F.sum("n").alias("n"))


def point_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """c, code_point, n over all texts (counted map-side before the one shuffle)."""
    chars = docs.select(F.explode(F.split(F.col(text_col), "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count("*").alias("n")).select("c", F.ascii("c").alias("code_point"), "n")


def has_category(char: Column, name: str) -> Column:
    """Whether a one-character string is of a general category, by its short name."""
    return char.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]$" if name == "LC" else rf"^\p{{{name}}}$")


def has_property(point: Column, name: str) -> Column:
    """Whether a code point has a block, script or binary property of few ranges; an unknown name has none."""
    out = F.lit(False)
    for a, b in property_ranges(name) or ():
        out = out | (point == a if a == b else point.between(a, b) if (a, b) != (0, LAST) else F.lit(True))
    return out


def ascii_class(c: Column) -> Column:
    """digit, letter, space, other or non-ascii for a one-character string."""
    p = F.ascii(c)
    return F.when(p > 127, "non-ascii").when(p.between(48, 57), "digit").when(p.between(65, 90) | p.between(97, 122), "letter").when(p.isin(9, 10, 11, 12, 13, 32), "space").otherwise("other")
