"""SimHash, spans and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from glyphflow.llm import simhash, span_dedup
from glyphflow.llm.components import components
from glyphflow.llm.simhash import fingerprint, keep_one, links_in_buckets, near_groups

DOCS = "doc_id long, text string"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    spans = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(rng, n=120):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    for i in range(40):
        base = rows[rng.randrange(n)][1].split()
        if base:
            base[rng.randrange(len(base))] = "edited"
        rows.append((n + i, "\n".join(base)))
    return rows


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    for _, text in [*corpus(rng), (0, None), (0, ""), (0, " \t\n"), (0, "One"), (0, "one TWO"), (0, "ÀÉ İ x y z w"), (0, "a " * 40_000)]:
        assert fingerprint(text) == brute_print(text)


def test_groups_against_brute_force(spark):
    rows = [*corpus(random.Random(2)), (500, None), (501, ""), (None, ""), (7, "a repeated row"), (7, "a repeated row")]
    got = near_groups(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS print", "2 AS low")).collect()
    prints = [brute_print(t) for _, t in rows]
    found = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    low = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        low[found[n]].append(i)
    want = sorted((str(i), f"{prints[n]:016x}", min(x for x in low[found[n]] if x is not None)) for n, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_buckets_lose_no_link_between_close_fingerprints():
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    near = {base}
    while len(near) < 1500:  # a dense group, so that buckets are divided
        near.add(int(rng.choice(list(near)[-50:])) ^ (1 << int(rng.integers(0, 26))))
    prints = np.sort(np.array(list(near), np.uint64))
    pairs = links_in_buckets(prints, np.zeros(len(prints), np.int64), list(range(64)))
    values = prints.tolist()
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in pairs)
    want = roots(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2])
    got = roots(range(len(values)), pairs)
    assert got == want


def test_near_lanes_counts_exactly():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 8, 200).astype(np.uint64) * np.uint64(0x0101010101010101)
    planes = simhash._planes(prints)
    for radius in (0, 1, 2, 3, 8):
        for shift in (1, 3):
            mask = simhash.near_lanes(planes, shift, (1 << (200 - shift)) - 1, radius)
            assert [mask >> i & 1 for i in range(200 - shift)] == [int((int(prints[i]) ^ int(prints[i + shift])).bit_count() <= radius) for i in range(200 - shift)]


def test_components_of_chains_loops_and_nothing(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 201), (201, 202), (202, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_the_smallest_id(spark):
    rows = [(3, "the same words here", 1), (2, "The same words here", 2), (2, "The same words here", 2), (9, "another text that is quite different", 3), (None, "x", 4), (None, "x", 4), (None, "an altogether different text here", 5), (None, "the same words here", 6)]
    got = sorted((tuple(r) for r in keep_one(spark.createDataFrame(rows, DOCS + ", component_id int")).collect()), key=str)
    assert got == [(2, "The same words here", 2), (9, "another text that is quite different", 3), (None, "an altogether different text here", 5), (None, "x", 4)]


def brute_spans(rows):
    first = {}
    parts = {}
    found = []
    for i, t in {(i, t) for i, t in rows if t}:
        parts[i, t] = span_dedup.sentences(t)
        for a, b in span_dedup.runs(parts[i, t], span_dedup.MIN_SENTENCES, span_dedup.MIN_WORDS):
            key = "\n".join(p[2] for p in parts[i, t][a : b + 1] if p[3])
            at = (-1 if i is None else i, span_dedup._print(t), a)
            found.append((key, at, (i, t), a, b))
            first[key] = min(first.get(key, at), at)
    gone = defaultdict(set)
    for key, at, doc, a, b in found:
        if at != first[key]:
            gone[doc].update(range(a, b + 1))
    out = []
    for i, t in rows:
        p = parts.get((i, t), [])
        out.append((str(i), "".join(t[x[0] : x[1]] for n, x in enumerate(p) if n not in gone[i, t]) if t else "", len(p), len(gone[i, t])))
    return sorted(out)


def test_spans_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 14))).capitalize() + rng.choice([". ", "! ", "?\n", ".\n\n"])
    passage = "".join(" ".join(word() for _ in range(11)) + ". " for _ in range(6))
    unbroken = " ".join(word() for _ in range(90))
    rows = [(i, "".join(sentence() for _ in range(rng.randint(0, 30)))) for i in range(40)]
    rows += [(100 + i, "".join(sentence() for _ in range(4)) + passage + sentence()) for i in range(5)]
    rows += [(200 + i, f"{sentence()}{unbroken} {sentence()}") for i in range(3)]
    rows += [(300, passage + "Middle. " + passage), (301, None), (302, ""), (303, rows[40][1]), (303, rows[40][1]), (None, passage), (304, "x" * 50_000)]
    got = span_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS at", "2 AS n_removed")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_sentences"], r["n_removed"]) for r in got) == brute_spans(rows)
    by = {r["doc_id"]: r for r in got}
    # The row without an id ranks first and keeps the passage; the others lose at least its inner sentences.
    assert all(passage[60:-60] not in by[i]["text"] for i in range(100, 105)) and by[300]["n_removed"] >= 10
    assert all(len(by[i]["text"]) < 450 for i in (201, 202))


def test_sentences_are_the_whole_text():
    for text in ["", "one", "One. Two! Three?\n\nFour", " \n ", "a.b c. " * 50, "w " * 300]:
        assert "".join(text[s:e] for s, e, *_ in span_dedup.sentences(text)) == text


def test_one_word_said_often_is_a_repeat(spark):
    rows = [(1, "start " + "der " * 400 + "end"), (2, "other " + "der " * 300 + "close")]
    got = {r["doc_id"]: len(r["text"].split()) for r in span_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] < 402 and got[2] < 150


def test_spans_of_nothing(spark):
    assert span_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_share_an_id_are_judged_in_their_own_groups(spark):
    first, second = "the same words stand here", "an altogether different text of its own"
    rows = [(1, first), (5, first), (5, second)]
    got = sorted(tuple(r) for r in keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, first), (5, second)]


def test_passages_of_51_words_in_running_text_hold_a_run():
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(3000)]
    for n in (51, 52, 60, 80):
        for _ in range(150):
            passage = rng.choices(vocabulary, k=n)
            texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(30, 90)), *passage, *rng.choices(vocabulary, k=rng.randint(30, 90))]) for _ in range(2)]
            keys = []
            for t in texts:
                parts = span_dedup.sentences(t)
                keys.append({tuple(p[2] for p in parts[a : b + 1]) for a, b in span_dedup.runs(parts, span_dedup.MIN_SENTENCES, span_dedup.MIN_WORDS)})
            assert keys[0] & keys[1], n


def tasks_of(spark, name, what):
    """What the function returns, and the tasks of its jobs."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = what()
    finally:
        context._jsc.clearJobGroup()
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))


def test_components_of_few_edges_are_found_in_one_task(spark, monkeypatch):
    import glyphflow.llm.components as module

    rng = random.Random(7)
    edges = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(350)] + [(5000 - i, 4999 - i) for i in range(60)] + [(1, None), (None, None), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(16).checkpoint()
    few, tasks = tasks_of(spark, "few-edges", lambda: sorted(map(tuple, components(frame).collect())))
    assert tasks <= 20
    monkeypatch.setattr(module, "AT_ONCE", 0)
    assert sorted(map(tuple, components(frame).collect())) == few
    whole = [e for e in edges if None not in e]
    want = roots({x for e in whole for x in e}, whole)
    assert dict(few) == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in whole)} and len(few) == len(dict(few))
