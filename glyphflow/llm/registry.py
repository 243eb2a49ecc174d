"""The queries of this package and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.plans.catalog import Query, table

from . import language_id, quality, toxicity
from .exact_dedup import exact_groups
from .exact_topk import top_k
from .line_dedup import dedup_lines
from .mixing import mix
from .packing import pack
from .simhash import near_groups
from .span_dedup import remove_repeats

WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


def op10_line_dedup(spark, sf_dir):
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# A row is a document, whether it shares its id or not; a line whose holders all lack an id stays.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {WHITE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.r, k.doc_id, k.line, k.i, f.keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language_id.predict_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "removed")


def op8_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "tokens", "block", "place")


OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT doc_id, source, coalesce('s:' || source, 'n:') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS tokens,
    coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(coalesce(text, '')) AS h
  FROM documents
), t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM m GROUP BY s),
shares AS (SELECT *, total / CAST(sum(total) OVER () AS DOUBLE) AS share FROM t),
r AS (SELECT max(share) / min(share) AS r FROM shares WHERE share > 0),
b(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2 THEN (lo + hi) / 2 ELSE hi END FROM b, r WHERE i < 60
), a AS (SELECT CASE WHEN r <= 2 THEN 0 ELSE hi END AS a FROM b, r WHERE i = 60),
w AS (SELECT s, total, n, CASE WHEN share > 0 THEN pow(share, a) ELSE 0 END AS raised FROM shares, a),
x AS (SELECT s, total, n, raised / sum(raised) OVER () AS weight FROM w),
own AS (SELECT *, CAST(round(weight * (SELECT max(total / weight) FROM x WHERE weight > 0)) AS BIGINT) AS own FROM x),
p AS (SELECT s, CASE WHEN total > 0 THEN own // total ELSE 1 END AS passes, CASE WHEN total > 0 THEN own % total ELSE 0 END AS rest,
  greatest(2, CAST(ceil(log2(greatest(1, max(n) OVER ()) / 512.0 + 1)) AS INTEGER)) AS bits FROM own),
o AS (SELECT m.*, passes, rest, bits, CAST('0x' || substr(md5(concat_ws(':', 7, passes, id, h)), 1, 15) AS BIGINT) AS ord FROM m JOIN p USING (s)),
k AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', 7, s, ord >> (60 - bits))), 1, 15) AS BIGINT) AS block FROM o),
u AS (SELECT s, block, rest, sum(tokens) AS tokens, sum(sum(tokens)) OVER (PARTITION BY s ORDER BY block) AS upto FROM k WHERE rest > 0 GROUP BY s, block, rest),
e AS (SELECT s, min(block) AS edge, arg_min(rest - upto + tokens, block) AS room FROM u WHERE upto > rest GROUP BY s),
v AS (SELECT s, ord, room, sum(tokens) OVER (PARTITION BY s ORDER BY ord) AS held FROM k JOIN e USING (s) WHERE block = edge),
c AS (SELECT s, max(ord) AS cut FROM v WHERE held <= room GROUP BY s),
f AS (SELECT k.*, unnest(range(passes + CASE WHEN edge > block OR (edge = block AND ord <= cut) THEN 1 ELSE 0 END)) AS copy FROM k LEFT JOIN e USING (s) LEFT JOIN c USING (s)),
g AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', 7, copy, id, h)), 1, 15) AS BIGINT) AS place FROM f)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, tokens, CAST('0x' || substr(md5(concat_ws(':', 7, s, place >> (60 - bits))), 1, 15) AS BIGINT) AS block, place FROM g
"""

QUERIES: dict[str, Query] = {
    "op1_exact_topk": Query(op1_exact_topk, OP1_SQL),
    "op2_toxicity": Query(op2_toxicity),
    "op3_packing": Query(op3_packing),
    "op4_simhash": Query(op4_simhash),
    "op5_language_id": Query(op5_language_id),
    "op6_substring_dedup": Query(op6_substring_dedup),
    "op7_exact_dedup": Query(op7_exact_dedup, OP7_SQL),
    "op8_quality": Query(op8_quality),
    "op9_mixing": Query(op9_mixing, OP9_SQL),
    "op10_line_dedup": Query(op10_line_dedup, OP10_SQL),
}
