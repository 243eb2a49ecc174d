"""Mixing, packing and the pipeline: round trips and brute force."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphflow.llm import mixing, packing
from glyphflow.llm.registry import QUERIES
from glyphflow.llm.simhash import fingerprint
from glyphflow.plans.catalog import table

DOCS = "doc_id long, text string, source string"


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = five(a), five(b)
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def sources(rng):
    rows = []
    for s, n in (("big", 400), ("mid", 120), ("small", 30), (None, 15)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(1, 40)), s) for k in range(n)]
    return rows


@pytest.mark.parametrize(("how", "block_docs"), [({}, 8), ({"max_repeats": 4.0}, 64), ({"target_entropy": 1.2}, 8), ({"budget_tokens": 3000}, 4)])
def test_mix_meets_its_budget(spark, how, block_docs):
    rows = sources(random.Random(1))
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs.selectExpr("*", "1 AS n", "'x' AS __text_", "0 AS copy"), block_docs=block_docs, **how).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    whole = sum(tokens.values())
    names = sorted(tokens, key=str)
    shares = [tokens[s] / whole for s in names]
    a = mixing.bisect_exponent(shares, how.get("target_entropy"), how.get("max_repeats", mixing.MAX_REPEATS))
    w = dict(zip(names, mixing.weights(shares, a), strict=True))
    budget = how.get("budget_tokens") or max(tokens[s] / w[s] for s in names)
    mixed, copies = Counter(), defaultdict(Counter)
    for r in got:
        mixed[r["source"]] += r["tokens"]
        copies[r["source"]][r["doc_id"]] += 1
        assert r["tokens"] == len(r["text"].split())
    for s in names:
        # Short of the budget by less than the document that didn't fit.
        assert round(w[s] * budget) - 40 < mixed[s] <= round(w[s] * budget)
        n = [copies[s][i] for i, _, x in rows if x == s]
        assert max(n) - min(n) <= 1
    if "budget_tokens" not in how:
        assert len({(r["doc_id"]) for r in got}) == len(rows)
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_exponent_meets_its_target():
    shares = [0.7, 0.2, 0.1]
    a = mixing.bisect_exponent(shares, None, 2.0)
    assert mixing.repeats(shares, a) == pytest.approx(2.0) and a == pytest.approx(1 - math.log(2) / math.log(7))
    assert mixing.bisect_exponent(shares, None, 100.0) == 0 and mixing.bisect_exponent(shares, None, 1.0) == pytest.approx(1)
    a = mixing.bisect_exponent(shares, 1.0, None)
    assert mixing.entropy(shares, a) == pytest.approx(1.0) and mixing.bisect_exponent(shares, 0.1) == 1.0
    assert mixing.bisect_exponent([], None, 2.0) == 0 and mixing.bisect_exponent([1.0], 0.5, None) == pytest.approx(0, abs=1e-9)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x y", "b"), (3, "x y", "b")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got if r["copy"] == 0) == Counter((i, t) for i, t, _ in rows)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def check_packing(pieces, texts, capacity=packing.CAPACITY):
    """Every document's ids come back from its pieces; sequences have no gap and no overlap."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r["length"] for r in pieces)


def test_packing_is_a_round_trip_and_tight(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    odd = [(9_000_004, "end <|endoftext|> of<|endoftext|>" + " and on" * 2000, "x"), (9_000_005, "<|endoftext|", "x"), (None, None, None), (9_000_001, "", "x"), (9_000_002, "word " * 5000, "x"), (9_000_003, "<|endoftext|> é \n\n  x", "x"), (9_000_003, "<|endoftext|> é \n\n  x", "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS)).selectExpr("*", "1 AS length", "2 AS ids")
    got = packing.pack(docs, keep_ids=True).collect()
    sequences, tokens = check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sequences <= 1.02 * tokens / packing.CAPACITY + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    few = packing.pack(docs.limit(50), shard_pieces=16).collect()
    assert len(few) >= 50
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_lengths_pack_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 20_000), np.full(500, 400), rng.integers(1, 30, 3000), rng.integers(500, 600, 999)][seed]
    sequence, offset = packing.pack_lengths(lengths)
    ends = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        ends[s].append((o, n))
    assert all(o == sum(n for _, n in sorted(own)[:k]) for own in ends.values() for k, (o, _) in enumerate(sorted(own)))
    assert all(sum(n for _, n in own) <= 1024 for own in ends.values())
    lower = [math.ceil(lengths.sum() / 1024) * 1.01, 250, math.ceil(lengths.sum() / 1024), 999][seed]
    assert len(ends) <= lower


def test_configurations_meet_the_demand():
    rng = np.random.default_rng(5)
    sizes = np.unique(rng.integers(100, 1000, 40))[::-1]
    demand = rng.integers(1, 50, len(sizes))
    got = np.zeros(len(sizes), int)
    for picked, times in packing.configurations(sizes, demand, 1024):
        assert times > 0 and sizes[picked].sum() <= 1024
        np.add.at(got, picked, times)
    assert got.tolist() == demand.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_the_linear_program_meets_the_demand_with_fewer_sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(257, [1000, 600, 420][seed], 150))[::-1]
    demand = rng.integers(1, 200, len(sizes))
    got, used = np.zeros(len(sizes), int), 0
    for picked, times in packing.optimised(sizes, demand, 1024):
        assert times > 0 and sizes[picked].sum() <= 1024
        np.add.at(got, picked, times)
        used += times
    assert got.tolist() == demand.tolist()
    # The program's bound: no price list under which no configuration is worth more than one sequence asks for more.
    searched = sum(times for _, times in packing.configurations(sizes, demand, 1024))
    assert used <= searched + 1 and used >= math.ceil((sizes * demand).sum() / 1024)
    assert packing.optimised(sizes, np.zeros(len(sizes), int), 1024) == []


def test_the_most_valuable_configuration_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = np.unique(rng.integers(257, 1000, 12))[::-1]
        price = rng.uniform(-0.2, 0.6, len(sizes))
        worth, picked = packing._priced(sizes, price, 1024)
        options = [()] + [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(len(sizes)), n)]
        best = max(sum(max(price[i], 0) for i in c) for c in options if sizes[list(c)].sum() <= 1024)
        assert worth == pytest.approx(best) and sizes[picked].sum() <= 1024
        assert sum(max(price[i], 0) for i in picked) == pytest.approx(worth)


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "12 34", "en", "s", 5), (None, "la de que el los", "es", "s", 17)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = [r.asDict() for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in after}
        if stage is corpus_pipeline.identify_language:
            assert not ids & {90_001, 90_002} and len(after) >= len(before) - 6
        elif stage is corpus_pipeline.drop_common_lines:
            assert len(after) == len(before)
        elif stage is corpus_pipeline.drop_near_copies:
            prints = [fingerprint(r["text"]) for r in after]
            assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
            # What goes is within 2 bits of another text, or like one by the stage's five words and similarity of 0.8.
            linked = [(fingerprint(r["text"]), r["text"]) for r in before]
            for g in (r["text"] for r in before if r["doc_id"] not in ids):
                assert sum((fingerprint(g) ^ p).bit_count() <= 2 for p, _ in linked) > 1 or sum(similar(g, t) for _, t in linked) > 1
            assert not any(similar(a["text"], b["text"]) for k, a in enumerate(after) for b in after[:k])
        else:
            assert ids == {r["doc_id"] for r in before}
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(last, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "lang_pred", "strength", "n_lines", "n_dropped", "tokens", "copy", "block", "place", "passes", "cut_block", "cut_order", "id", "print", "doc", "k", "m", "t", "gone", "__id", "node", "root", "a.b"]
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    docs = docs.unionByName(docs.limit(3)).select("*", *[F.concat(F.lit(n), F.lit(k), F.col("doc_id").cast("string")).alias(n) for k, n in enumerate(names)])
    rows = [r.asDict() for r in docs.collect()]
    given = {r["doc_id"]: r for r in rows}
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.schema.names == docs.schema.names, name
        after = [r.asDict() for r in got.collect()]
        assert after and all(r[n] == given[r["doc_id"]][n] for r in after for n in names), name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)


def test_a_budget_keeps_the_limit_of_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b c", "y"), (3, "word " * 50, "z")], DOCS)
    for how, most in (({"budget_tokens": 100_000}, 2), ({"budget_tokens": 100_000, "max_repeats": 5.0}, 5)):
        copies = Counter(r["doc_id"] for r in mixing.mix(docs, **how).collect())
        assert copies == {1: most, 2: most, 3: most}
    rows = sources(random.Random(4))
    got = mixing.mix(spark.createDataFrame(rows, DOCS), budget_tokens=15_000, block_docs=4).collect()
    size, copies = {i: len(t.split()) for i, t, _ in rows}, Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= 2 and 15_000 - 4 * 40 < sum(size[i] * n for i, n in copies.items()) <= 15_000
    free = Counter(r["doc_id"] for r in mixing.mix(docs, budget_tokens=10_000, max_repeats=None).collect())
    assert sum({1: 2, 2: 3, 3: 50}[i] * n for i, n in free.items()) > 9_900


def test_the_sums_of_shares_give_the_same_exponents(spark):
    shares = [0.5, 0.2, 0.2, 0.06, 0.04]
    frame = spark.createDataFrame([(str(i), p) for i, p in enumerate(shares)], "source string, share double")
    for x, got in zip((0.0, 0.3, 1.0), mixing._entropies(frame, [0.0, 0.3, 1.0]), strict=True):
        assert got == pytest.approx(mixing.entropy(shares, x))
    coarse = mixing._boundary(lambda grid: [mixing.entropy(shares, x) >= 1.4 for x in grid], mixing.GRID)[0]
    assert coarse == pytest.approx(mixing.bisect_exponent(shares, 1.4), abs=1e-12)


def test_pipeline_runs_as_a_whole(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r["sequence_id"] for r in rows}) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11))
