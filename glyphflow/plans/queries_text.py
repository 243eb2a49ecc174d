"""Text, Unicode and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.functions import text as X
from glyphflow.plans.catalog import register, table, texts

# General categories and re-grouped counts agree between engines on the letters that the tables hold.
_CHARS = "c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), k AS (SELECT unicode(c) AS p, count(*) AS n FROM c WHERE c <> '' GROUP BY c)"
CATEGORIES = {"L": r"\p{L}", "Lu": r"\p{Lu}", "Ll": r"\p{Ll}", "Nd": r"\p{Nd}", "P": r"\p{P}", "S": r"\p{S}", "Zs": r"\p{Zs}", "Cc": r"\p{Cc}"}


@register("unicode_category_counts", f"WITH {_CHARS} " + " UNION ALL ".join(f"SELECT '{n}' AS category, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM k WHERE regexp_matches(chr(p), '{p}')" for n, p in CATEGORIES.items()))
def unicode_category_counts(spark, sf):
    points = X.point_counts(texts(spark, sf, "documents"))
    sums = points.agg(*[F.coalesce(F.sum(F.when(X.has_category(F.col("c"), n), F.col("n"))), F.lit(0)).alias(n) for n in CATEGORIES])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in CATEGORIES])).alias("x")).select("x.category", "x.n")


def _ranges_sql(kind: str) -> str:
    from glyphflow.functions.unicode_tables import BLOCKS, SCRIPTS

    rows = [(n, a, b) for n, (a, b) in BLOCKS.items()] if kind == "block" else [(n, a, b) for n, f in SCRIPTS.items() for a, b in zip(f[::2], f[1::2], strict=True)]
    return "(VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in rows) + ") AS r(name, first, last)"


@register("unicode_block_join", f"WITH {_CHARS} SELECT name, CAST(sum(n) AS BIGINT) AS n FROM k JOIN {_ranges_sql('block')} ON p BETWEEN first AND last GROUP BY name")
def unicode_block_join(spark, sf):
    return X.count_by_range(X.point_counts(texts(spark, sf, "documents")), "block")


@register("unicode_script_join", f"WITH {_CHARS} SELECT name, CAST(sum(n) AS BIGINT) AS n FROM k JOIN {_ranges_sql('script')} ON p BETWEEN first AND last GROUP BY name")
def unicode_script_join(spark, sf):
    return X.count_by_range(X.point_counts(texts(spark, sf, "documents")), "script")


_BINARY = {
    "ASCII_Hex_Digit": "p BETWEEN 48 AND 57 OR p BETWEEN 65 AND 70 OR p BETWEEN 97 AND 102",
    "White_Space": "p BETWEEN 9 AND 13 OR p IN (32, 133, 160)",
    "Pattern_Syntax": "p BETWEEN 33 AND 47 OR p BETWEEN 58 AND 64 OR p BETWEEN 91 AND 96 OR p BETWEEN 123 AND 126",
    "Extender": "p = 95 OR p >= 183",
    "Soft_Dotted": "p IN (105, 106)",
    "Quotation_Mark": "p IN (34, 39, 171, 187, 8216, 8217, 8220, 8221)",
}


@register("binary_props", f"WITH {_CHARS} " + " UNION ALL ".join(f"SELECT '{n}' AS property, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM k WHERE {c}" for n, c in _BINARY.items()))
def binary_props(spark, sf):
    points = X.point_counts(texts(spark, sf, "documents"))
    sums = points.agg(*[F.coalesce(F.sum(F.when(X.has_property(F.col("code_point"), n), F.col("n"))), F.lit(0)).alias(n) for n in _BINARY])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).alias("n")) for n in _BINARY])).alias("x")).select("x.property", "x.n")


@register("property_names", "SELECT * FROM (VALUES ('Lowercase_Letter', 'Ll', 'category'), ('is-greek', 'Greek', 'script'), ('InBasic Latin', 'Basic_Latin', 'block'), ('xidstart', 'XID_Start', 'binary'), ('Nope', NULL, NULL)) AS t(name, canonical, kind)")
def property_names(spark, sf):
    from glyphflow.functions.unicode_tables import normalize_name

    rows = [(n, *(normalize_name(n) or (None, None))) for n in ("Lowercase_Letter", "is-greek", "InBasic Latin", "xidstart", "Nope")]
    return spark.createDataFrame(rows, "name string, canonical string, kind string")


@register("utf8_lengths", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes, CAST(length(text) AS INTEGER) AS n_points, strlen(text) = length(text) AS is_ascii FROM documents")
def utf8_lengths(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.char_length("text").alias("n_points"), X.is_ascii(F.col("text")).alias("is_ascii"))


@register("codepoint_decode", "SELECT n_name, list_transform(list_filter(string_split(n_name, ''), lambda c: c <> ''), lambda c: unicode(c)) AS points FROM nation")
def codepoint_decode(spark, sf):
    return table(spark, sf, "nation").select("n_name", X.code_points(F.col("n_name")).alias("points"))


@register("ascii_classes", """
WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents)
SELECT CASE WHEN unicode(c) > 127 THEN 'non-ascii' WHEN c BETWEEN '0' AND '9' THEN 'digit' WHEN unicode(lower(c)) BETWEEN 97 AND 122 THEN 'letter' WHEN unicode(c) IN (9, 10, 11, 12, 13, 32) THEN 'space' ELSE 'other' END AS class, count(*) AS n
FROM c WHERE c <> '' GROUP BY 1
""")
def ascii_classes(spark, sf):
    chars = texts(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return chars.groupBy(X.ascii_class(F.col("c")).alias("class")).agg(F.count("*").alias("n"))


@register("hex_escape_parse", r"SELECT p_partkey, '\x{' || lower(hex(p_partkey)) || '}' AS escape, CAST(p_partkey AS INTEGER) AS code_point FROM part UNION ALL SELECT p_partkey, '\x4' || hex(p_size % 10), CAST(64 + p_size % 10 AS INTEGER) FROM part")
def hex_escape_parse(spark, sf):
    value = F.concat(F.lit(r"a\x{"), F.lower(F.hex("p_partkey")), F.lit(r"} \x4"), F.hex(F.col("p_size") % 10), F.lit(r"\xZZ"))
    rows = texts(spark, sf, "part").select("p_partkey", F.explode(X.hex_escapes(value)).alias("x"))
    return rows.select("p_partkey", "x.escape", "x.code_point")


@register("grapheme_bounds", "SELECT n_name, [CAST(x AS INTEGER) FOR x IN range(length(n_name))] AS starts FROM nation")
def grapheme_bounds(spark, sf):
    return table(spark, sf, "nation").select("n_name", X.grapheme_starts(F.col("n_name")).alias("starts"))


@register("nfc_equivalence", "SELECT doc_id, true AS same, text = nfc_normalize(text) AS is_nfc FROM documents")
def nfc_equivalence(spark, sf):
    """Every document is canonically equivalent to its decomposition."""
    text = F.col("text")
    return texts(spark, sf, "documents").select("doc_id", X.canonically_equivalent(X.normalize(text, "NFD"), text).alias("same"), (X.normalize(text) == text).alias("is_nfc"))


@register("nfkc_lengths")
def nfkc_lengths(spark, sf):
    forms = [F.char_length(X.normalize(F.col("text"), f)).alias(f.lower()) for f in ("NFC", "NFD", "NFKC", "NFKD")]
    return texts(spark, sf, "documents").select("doc_id", *forms)


@register("bom_detection", "SELECT * FROM (VALUES ('EFBBBF61', 'UTF-8', 3, 'a'), ('FFFE6100', 'UTF-16LE', 2, 'a'), ('FEFF0061', 'UTF-16BE', 2, 'a'), ('FFFE000061000000', 'UTF-32LE', 4, 'a'), ('0000FEFF00000061', 'UTF-32BE', 4, 'a'), ('61', 'UTF-8', 0, 'a')) AS t(data, encoding, mark_bytes, text)")
def bom_detection(spark, sf):
    rows = [(x,) for x in ("EFBBBF61", "FFFE6100", "FEFF0061", "FFFE000061000000", "0000FEFF00000061", "61")]
    data = spark.createDataFrame(rows, "data string").withColumn("b", F.unhex("data"))
    return data.select("data", X.detect_encoding(F.col("b")).alias("e"), X.decode_with_bom(F.col("b")).alias("text")).select("data", "e.encoding", "e.mark_bytes", "text")


@register("encoding_round_trip", "SELECT doc_id, true AS same FROM documents")
def encoding_round_trip(spark, sf):
    """Every text comes back from UTF-16 with a byte-order mark."""
    data = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    return texts(spark, sf, "documents").select("doc_id", (X.decode_with_bom(data) == F.col("text")).alias("same"))


@register("valid_code_points", "SELECT doc_id, true AS valid FROM documents")
def valid_code_points(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", X.valid_code_points(F.col("text")).alias("valid"))


@register("source_table", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS file_name, CAST(strlen(text) AS INTEGER) AS n_bytes, sha256(text) AS text_sha256 FROM documents")
def source_table(spark, sf):
    from glyphflow.sources import from_bytes

    docs = texts(spark, sf, "documents").withColumn("b", F.encode("text", "UTF-8"))
    return from_bytes(docs, "b", "doc_id", "source").select("doc_id", "file_name", "n_bytes", F.sha2("text", 256).alias("text_sha256"))
