"""Operators that SQL or a few lines of Python can express: hand-made cases against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from glyphflow.llm import exact_topk, line_dedup
from glyphflow.llm.exact_dedup import exact_groups
from glyphflow.llm.exact_topk import search_blocks, top_k
from glyphflow.llm.line_dedup import dedup_lines
from glyphflow.llm.mphf import PerfectHash
from glyphflow.llm.registry import QUERIES

DOCS = "doc_id long, text string"


def brute_top_k(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in ok:
        if q % 20:
            continue
        best = sorted((-sum(a * b for a, b in zip(e, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (None, [1.0] * 6), (1020, [float("nan")] * 6), (1040, [None, 1.0]), (1060, [float("inf")]), (1080, []), (1100, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id")
    got = sorted(tuple(r) for r in top_k(frame.selectExpr("*", "1 AS score", "2 AS rank"), k=7).collect())
    assert got == brute_top_k(rows, 7)


def test_top_k_over_many_shards_visits_few(spark, monkeypatch):
    rng = random.Random(5)
    for name, value in (("MIN_SHARD_ROWS", 50), ("MAX_SHARD_ROWS", 50), ("BLOCK_ROWS", 8), ("GROUP_ROWS", 7), ("SUMMARY_BYTES", 16 * 6 * 8)):
        monkeypatch.setattr(exact_topk, name, value)
    # Neighbouring ids lie near each other, so most shards can't hold a query's best.
    rows = [(i, [(i // 100) + rng.random() if d == (i // 200) % 6 else rng.random() / 8 for d in range(6)]) for i in range(1200)]
    rows += [(40, [9.0] * 6), (40, [8.0] * 6), (1300, [-1.0] * 6), (1320, [0.0] * 6)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9), k=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(rows, 7)
    rows = sorted(rows)
    vectors = np.array([[math.floor(64 * x) for x in v] for _, v in rows], float)
    extremes = exact_topk.Extremes([(s, vectors[s * 50 : s * 50 + 50].max(0).tobytes(), vectors[s * 50 : s * 50 + 50].min(0).tobytes()) for s in range(len(rows) // 50)], 1 << 20)
    bounds = extremes.bounds(vectors)
    scores = vectors @ vectors.T
    assert all((bounds[:, s] >= scores[:, s * 50 : s * 50 + 50].max(1)).all() for s in range(len(rows) // 50))
    count = [0, 0]
    blocks = [{"ids": np.arange(a, a + 8), "m": vectors[a : a + 8], "high": vectors[a : a + 8].max(0), "low": vectors[a : a + 8].min(0)} for a in range(0, 1200, 8)]
    least = np.sort(scores[::20, :1200], axis=1)[:, -8]
    row, ids, found = search_blocks(blocks, vectors[::20], np.arange(0, len(vectors), 20), 7, least, count)
    assert count[0] < count[1] / 2 and (found >= least[row]).all()


def test_top_k_of_huge_values_is_exact():
    m = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**62), 0.0]])
    block = {"ids": np.array([1, 2, 3]), "m": m, "high": m.max(0), "low": m.min(0)}
    row, ids, scores = search_blocks([block], np.array([[2.0**20, 3.0]]), np.array([0]), 3)
    assert ids.tolist() == [2, 1, 3] and scores.tolist() == [2**60 + 6, 2**60 + 3, -(2**63)]


def test_top_k_of_nothing_and_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)).collect()] == [(0, 1, 1, 64 * 32)]
    assert top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_exact_groups_with_ties_nulls_and_repeats(spark):
    rows = [(1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "x"), (7, "x")] + [(i, "hot") for i in range(100, 160)]
    got = exact_groups(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS digest", "2 AS kept")).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for digest, ids in groups.items():
        own = [r for r in got if r["text_sha256"] == digest]
        keep = max(i for i in ids if i is not None)
        assert {r["keep_id"] for r in own} == {keep} and {r["group_size"] for r in own} == {len(ids)}
        assert [r["doc_id"] for r in own if r["kept"]] == [keep]


@pytest.mark.parametrize("support", [1 / 512, 0.9])
def test_frequent_and_ordinary_digests_agree(spark, support):
    rows = [(i, "same" if i % 2 else f"own {i % 40}") for i in range(200)]
    got = sorted(tuple(r) for r in exact_groups(spark.createDataFrame(rows, DOCS), support=support).drop("text_sha256").collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows)


def test_exact_groups_of_nothing(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def brute_lines(rows, min_chars=20, min_docs=3):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for key in {x.strip(line_dedup.WHITE).translate(low) for x in (t or "").split("\n")}:
            if len(key) >= min_chars:
                held[key].append((n, i))
    common = {k: max((i for _, i in v if i is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(line_dedup.WHITE).translate(low) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if k not in common or common[k] is None or common[k] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINE = "This Line stands in MANY documents"
LINE_ROWS = [
    (1, f"{LINE}\nown one\n{LINE}"),
    (2, f"  {LINE.lower()}\t\nown two"),
    (3, f"before\n\n{LINE.upper()}\x0b\nafter"),
    (4, "short\nshort"),
    (5, "short"),
    (6, "short"),
    (7, None),
    (8, ""),
    (9, "ÉÉÉÉÉÉÉÉÉÉ twenty chars"),
    (10, "éééééééééé twenty chars"),
    (11, "ÉÉÉÉÉÉÉÉÉÉ twenty chars"),
    (12, "exactly nineteen ch"),
    (None, f"{LINE}\nno id"),
    (13, "a\nonly rows without id hold me\nb"),
    *[(None, "rows without any id hold this line")] * 3,
    *[(20, "one id, three rows, one very long line " + "x" * 5000)] * 3,
]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines_against_brute_force(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    docs = spark.createDataFrame([(*r, 5) for r in LINE_ROWS], DOCS + ", n_lines int").selectExpr("*", "'x' AS blob")
    got = dedup_lines(docs, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["doc_id", "text", "blob", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.drop("blob").collect()), key=str) == brute_lines(LINE_ROWS)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("often", [4, 10**9])
def test_lines_that_nearly_all_hold_are_answered_where_they_stand(spark, broadcast_bytes, often, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", often)
    rows = [(i % 150, f"every one of us holds this line\nand some hold this one: number {i % 7}\nown line of the document {i}") for i in range(200)]
    got = dedup_lines(spark.createDataFrame(rows, DOCS), broadcast_bytes=broadcast_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows)


def test_lines_query_and_its_twin_agree_on_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, LINE), (1, f"{LINE}\nx"), (2, LINE), (3, None), (None, f"{LINE}\nno id"), *[(None, "held only by rows that have no id")] * 3, (4, ""), (4, "")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_line_dedup"].run(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(QUERIES["op10_line_dedup"].sql).fetchall()
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))) == sorted(map(str, want)) and len(want) == len(rows)
    assert [r["n_dropped"] for r in got.where("doc_id = 1").collect()] == [1, 1]


def test_lines_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 50_000, dtype=np.uint64) for _ in range(2))
    a[1] = a[0]  # half a key may repeat
    index = PerfectHash(a, b)
    assert index.n == len(a) and sorted(index.find(a, b).tolist()) == list(range(len(a)))
    other = index.find(b, a)
    assert other.min() >= -1 and other.max() < index.n
    assert PerfectHash(a[:0], b[:0]).find(a[:2], b[:2]).tolist() == [-1, -1]
