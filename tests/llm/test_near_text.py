"""The pipeline's similarity pass against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from glyphflow.llm import near_text
from glyphflow.llm.near_text import keep_one_similar, similar_groups

DOCS = "doc_id long, text string"


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = five(a), five(b)
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, times):
    words = text.split()
    for at in rng.sample(range(len(words)), times):
        words[at] = f"edit{rng.random()}"
    return " ".join(words)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + 10 * k + i, edited(rng, t, k)) for k in (1, 3, 5, 20, 40) for i, t in enumerate(base[:10])]
    rows += [(None, edited(rng, base[30], 2)), (900, None), (901, ""), (902, "short text")]
    docs = spark.createDataFrame(rows, DOCS)
    want = {frozenset((a, b)) for n, (_, a) in enumerate(rows) for _, b in rows[:n] if a != b and similar(a, b)}
    told = {r["doc_id"]: r["root"] for r in similar_groups(docs).collect()}
    by_text = {t: told[i] for i, t in rows if i in told}
    assert len(want) > 50 and sum(by_text[a] == by_text[b] for a, b in want) >= 0.99 * len(want)
    got = {tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert not any(similar(a, b) for _, a in got for _, b in got if a != b)
    assert {(i, t) for i, t in rows[:40]} <= got and {r for r in rows if r[0] and 130 <= r[0] < 150 and not similar(r[1], base[(r[0] - 100) % 10])} <= got
    assert keep_one_similar(docs.limit(0)).count() == 0


def test_crowded_buckets_go_by_rounds(spark):
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = rng.choices(vocabulary, k=200)
    rows = [(0, " ".join(base))]
    # One group of many near copies, and a chain in which each is like its neighbours alone.
    rows += [(1 + i, edited(rng, " ".join(base), 1)) for i in range(150)]
    step = rng.choices(vocabulary, k=300)
    for i in range(30):
        rows.append((1000 + i, " ".join(step)))
        for at in range(i * 8, i * 8 + 8):
            step[at] = f"chain{i}-{at}"
    rows += [(2000 + i, " ".join(rng.choices(vocabulary, k=200))) for i in range(20)] + [(1, rows[1][1]), (None, rows[0][1]), (3000, None), (3001, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS doc", "1 AS node", "2 AS k", "3 AS m", "4 AS t", "5 AS stays", "6 AS n")
    got = keep_one_similar(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    alive = [(i, t) for i, t in kept if t]
    assert not any(similar(a, b) for n, (_, a) in enumerate(alive) for _, b in alive[:n])
    assert {i for i, _ in kept} >= {0, 1000, 3000, 3001, *range(2000, 2020)} and not {i for i, _ in kept} & set(range(1, 151))
    for i, t in rows:
        assert not t or (i, t) in kept or any(similar(t, other) for _, other in rows if other and other != t) or i is None


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_buckets_are_streams(rows):
    rng = np.random.default_rng(rows)
    sizes = [1, 2, 9, 1, 40, 3, 8, 12, 1]
    buckets = {k: np.sort(rng.choice(10_000, n, replace=False)) - 5_000 for k, n in zip(range(-4, 5), sizes, strict=True)}
    # Repeated rows count once.
    pairs = sorted((k, int(n)) for k, nodes in buckets.items() for n in [*nodes, *nodes[::2]])
    key, node = np.array(pairs, np.int64).T
    batches = [pa.record_batch([pa.array(key[i : i + rows]), pa.array(node[i : i + rows])], ["key", "node"]) for i in range(0, len(key), rows)]
    for few in (1, 8, 11):
        got = [tuple(r.values()) for b in near_text._crowded(few)(batches) for r in b.to_pylist()]
        assert sorted(got) == [(k, n) for k, nodes in buckets.items() for n in nodes if len(nodes) > few]
    for near in (2, 10, 64):
        got = {tuple(r.values()) for b in near_text._pairs(near)(batches) for r in b.to_pylist()}
        met = [(nodes, i, j) for nodes in buckets.values() for j in range(len(nodes)) for i in range(j)]
        assert got == {(int(x[i]), int(x[j])) for x, i, j in met if i == 0 or j < near_text.FEW or j - i <= near}
        assert all((x[i], x[j]) in got for x, i, j in met if len(x) <= max(near_text.FEW, near + 2))
    assert not list(near_text._pairs(2)([])) and not list(near_text._crowded(1)([]))


def test_bitmaps_leave_out_no_similar_pair():
    rng = np.random.default_rng(5)
    out = 0
    for n in (1, 5, 40, 150, 800, 5000):
        for part in (0.7, 0.8, 0.85, 0.9, 0.95, 1.0):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            b = np.unique(np.r_[a[: int(part * len(a))], rng.integers(0, 1 << 64, rng.integers(0, 1 + n // 5), np.uint64)])
            shared = len(np.intersect1d(a, b))
            alike = 5 * shared >= 4 * (len(a) + len(b) - shared)
            may = near_text.may_be_alike(np.array([len(a)]), near_text.bitmap(a)[None], np.array([len(b)]), near_text.bitmap(b)[None])[0]
            assert may or not alike
            out += not may
    assert out > 5


@pytest.mark.parametrize("rows", [1, 7, 50, 1000])
def test_pairs_that_cannot_be_alike_are_not_made(rows):
    rng = np.random.default_rng(rows)
    # A crowded bucket of texts of which each shares two thirds with each other, and two near copies among them.
    common = rng.integers(0, 1 << 64, 100, np.uint64)
    sets = {int(n): np.unique(np.r_[common, rng.integers(0, 1 << 64, 25, np.uint64)]) for n in rng.choice(10_000, 300, replace=False)}
    x, y = sorted(sets)[100], sorted(sets)[200]
    sets[y] = sets[x][:-3]
    told = [(k, n, len(sets[n]), near_text.bitmap(sets[n]).tobytes()) for k in (4, 9) for n in sorted(sets)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*told[i : i + rows]), kinds)], ["key", "node", "n", "bits"]) for i in range(0, len(told), rows)]
    got = {tuple(r.values()) for b in near_text._pairs(512)(batches) for r in b.to_pylist()}
    every = {(a, b) for a in sets for b in sets if a < b}
    alike = {(a, b) for a, b in every if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert (x, y) in alike and alike <= got <= every and len(got) < len(every) / 5
