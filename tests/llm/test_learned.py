"""Learned operators: held-out accuracy, and defined results for odd input."""

import math
import random
import zlib

import numpy as np
import pytest

from glyphflow.llm import language_id, quality, toxicity
from glyphflow.plans.catalog import table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string"
ODD = [(900_001, None, None), (900_002, "", "en"), (900_003, "1234 !!", "en"), (900_004, "the and of " * 30_000, "en"), (None, "the of and", "en"), (900_005, "the of and", "en"), (900_005, "the of and", "en")]


def crc(i):
    return zlib.crc32(str(i).encode())


def held_out(rows, modulus, rest):
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (crc(r["doc_id"]) % modulus == rest)
        else:
            assert r["held_out"] is False


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(ODD, DOCS))
    got = language_id.predict_documents(docs.selectExpr("*", "1 AS grams", "'x' AS lang_pred")).collect()
    held_out(got, 4, 2)
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    fresh = [r for r in got if r["held_out"] and r["doc_id"] < 900_000]
    assert np.mean([true[r["doc_id"]] == r["lang_pred"] for r in fresh]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (900_001, 900_002, 900_003)] == ["und"] * 3 and by[900_004] == "en" and by[None] is not None


def test_language_without_anything_to_learn(spark):
    rows = [(1, "some text", None), (2, None, None)]
    assert [r["lang_pred"] for r in language_id.predict_documents(spark.createDataFrame(rows, DOCS)).collect()] == ["und", "und"]
    assert language_id.predict_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_presence_takes_the_whole_text():
    head = "ab" * 100_000
    assert not language_id.presence(head)[language_id.presence("zq")].all() and language_id.presence(head + "zq")[language_id.presence("zq")].all()


@pytest.mark.parametrize(("score", "label", "modulus", "rest", "recall"), [(toxicity.score_documents, "toxic", 3, 1, 0.9), (quality.score_documents, "quality", 5, 0, 0.95)])
def test_labels_of_held_out_documents(spark, score, label, modulus, rest, recall):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(ODD, DOCS))
    labels = table(spark, SF, "labels")
    got = score(docs.selectExpr("*", "1 AS score", "2 AS y"), labels).collect()
    assert len(got) == docs.count()
    held_out(got, modulus, rest)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    true = {r["doc_id"]: r[label] for r in labels.collect()}
    fresh = [r for r in got if r["held_out"] and true.get(r["doc_id"]) is not None]
    hits = [r["predicted"] for r in fresh if true[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in fresh if true[r["doc_id"]] == 0]
    assert np.mean(hits) >= recall and np.mean(wrong) <= 0.02
    same = {r["score"] for r in got if r["doc_id"] in (900_005, None)}
    assert len(same) == 1


@pytest.mark.parametrize("score", [toxicity.score_documents, quality.score_documents])
def test_scores_without_labels(spark, score):
    docs = spark.createDataFrame([(1, "a text", "en"), (2, None, "en")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unknown = spark.createDataFrame([(1, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, unknown):
        assert {r["doc_id"] for r in score(docs, labels).collect()} == {1, 2}
        assert score(docs.limit(0), labels).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(8)
    entries = ["idiot", "scum", "worthless", "disgusting", "aabab", "aab", "abababab"]
    trie = toxicity.Trie(entries)
    tokens = [*entries, "", "a"]
    for e in entries * 60:
        t = list(e)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        tokens.append("".join(t))
    for t in tokens:
        want = {n: d for n, e in enumerate(entries) if t and t[0] == e[0] and (d := edits(t, e)) <= min(toxicity.allowed_edits(len(e)), toxicity.allowed_edits(len(t) + 1))}
        assert dict(trie.match(t)) == want, t


def test_judge_agrees_with_plain_edit_distance():
    rng = random.Random(10)
    entries = ["idiot", "stupid", "scum", "worthless", "disgusting", "aab", "abababab", "lowei*"]
    judge = toxicity.Judge(entries)
    tokens = ["1diot", "ldiot", "tupid", "diot", "xstupid", "orthless", "", "a", "lowei" + "x" * 60, "plowei", "idiot" + "x" * 60]
    for e in entries * 150:
        t = list(e.rstrip("*"))
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, rng.randrange(len(t) + 1)])
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "1"])
        tokens.append("".join(t))
    for t in tokens:
        within = [d for e in entries[:-1] if (d := edits(t, e)) <= min(toxicity.allowed_edits(len(e)), toxicity.allowed_edits(len(t) + 1))]
        want = min([*within, *[0] * t.startswith("lowei")], default=-1)
        assert judge.edits(t) == want, t
    assert [judge.edits(t) for t in tokens[:4]] == [1, 1, 1, 1] and judge.edits(tokens[8]) == 0


def test_pieces_reject_no_token_that_matches():
    rng = random.Random(9)
    entries = ["idiot", "scum", "worthless", "disgusting", "aab", "abababab"]
    pieces = toxicity.Pieces(entries)
    seen = set()
    for e in entries * 400:
        t = list(e)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        token = "".join(t)
        near = any(edits(token, x) <= toxicity.allowed_edits(len(x)) for x in entries)
        assert pieces.allow(token) or not near, token
        seen.add((near, pieces.allow(token)))
    assert (False, False) in seen and (True, True) in seen


def test_scripts_without_spaces_are_read_in_pairs():
    assert toxicity.tokens_of("He said 你好世界, ok ไทย x你") == ["he", "said", "你好", "好世", "世界", "ok", "ไท", "ทย", "x", "你"]
    judge = toxicity.Judge(["好世"])
    assert judge.hits("坏你好世界了")[0][0][0] == "好世" and judge.hits("他说“你好世界”。 idiot")[0][0][2]
    assert judge.hits("好 世")[0] == []


def test_tokens_of_any_length_against_plain_edit_distance():
    rng = random.Random(14)
    entries = ["".join(rng.choices("abc", k=n)) for n in (4, 5, 8, 9, 12, 30, 60, 200)] + ["badword"]
    judge = toxicity.Judge(entries)
    for e in entries * 12:
        t = list(e)
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, rng.randrange(len(t) + 1)])
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        t = "".join(t)
        within = [d for x in entries if (d := edits(t, x)) <= min(toxicity.allowed_edits(len(x)), toxicity.allowed_edits(len(t) + 1))]
        assert judge.edits(t) == min(within, default=-1), t
    assert judge.edits("vadword") == 1


def test_every_score_is_what_its_counts_give(spark):
    """Scores of a whole small table against the definition: tokens, plain edit distance, windows, logistic."""
    rng = random.Random(15)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(3, 30))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["dreadful", "horrible", "dreadfol", "horible"])
        rows.append((i, " ".join(words)))
    rows += [(500, "a " * 40_000 + "dreadful"), (501, None), (502, ""), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    judge = toxicity.fit(docs, labels, toxicity.crc_of_id("doc_id") % 3 != 1)
    got = {(r["doc_id"]): r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    for i, text in rows:
        tokens = (text or "").lower().split()
        found = []
        for at, t in enumerate(tokens):
            near = [0 for e in judge.beginnings if t.startswith(e)] + [d for e in judge.words if (d := edits(t, e)) <= min(toxicity.allowed_edits(len(e)), toxicity.allowed_edits(len(t) + 1))]
            if near and (min(near) == 0 or t not in judge.harmless):
                window = tokens[max(0, at - 5) : at] + tokens[at + 1 : at + 6]
                found.append((min(near), sum(judge.context.get(w, 0.0) for w in window) / len(window) if window else 0.0))
        exact, close = sum(k == 0 for k, _ in found), sum(k > 0 for k, _ in found)
        x = [math.log1p(exact), math.log1p(close), 0.0, math.log1p(100 * len(found) / max(len(tokens), 1)), sum(w for _, w in found) / len(found) if found else 0.0]
        z = judge.weights[0] + sum(a * b for a, b in zip(judge.weights[1:], x, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z))), text


def brute_statistics(text):
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    logit = lambda x, n: math.log((x + 0.5) / (n - x + 0.5))
    upper, digits = sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw)
    letters = sum(97 <= c <= 122 or c >= 128 for c in raw) + upper
    marks = sum(33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in raw)
    n, sizes = len(words), [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    solid = len(raw)
    return [
        math.log1p(len(raw)), math.log1p(mean), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))), logit(upper, letters), logit(digits, solid), logit(marks, solid),
        logit(sum(words[i] == words[i + 1] for i in range(n - 1)), max(n - 1, 0)), logit(max((words.count(w) for w in set(words)), default=0), n), logit(len(set(words)), n), logit(words.count(b"|"), n),
        logit(len(lines) - len(set(lines)), len(lines)), math.log((n + 1) / (sum(raw.count(c) for c in (b".", b"!", b"?")) + 1)), logit(sum(w[-1:] in [bytes([c]) for c in b"!#$%&*+=@^~|<>"] for w in words), n),
    ]


def test_quality_statistics_and_scores_against_brute_force():
    rng = np.random.default_rng(16)
    texts = [None, "", " ", "One. Two!\nOne. Two!\n| | x9", "É " * 3000, "a\nb\na\n\n"]
    texts += [" ".join(rng.choice(["word", "Word", "12", "x!", "|", "the.", "\n"], rng.integers(1, 80))) for _ in range(60)]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(brute_statistics(t)), t
    x = np.array([quality.statistics(t) for t in texts])
    model = quality.Discriminant(x, np.arange(len(x)) % 2)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    logs = []
    pooled = sum(np.cov(z[np.arange(len(z)) % 2 == c].T, bias=True) * (np.arange(len(z)) % 2 == c).sum() for c in (0, 1)) / len(z)
    for c in (0, 1):
        own = z[np.arange(len(z)) % 2 == c]
        s = 0.8 * np.cov(own.T, bias=True) + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        d = z - own.mean(0)
        logs.append(math.log(len(own) / len(z)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def test_language_scores_against_the_kernel_written_out(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choices(["the", "and", "of"] if i % 2 else ["der", "und", "das"], k=6)) + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, "½ ² ① 12", None), (101, "ª", None), (102, "und" * 30_000, None)] + [(200 + k, f"zz{k} qq", f"l{k}") for k in range(260)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    assert len(model.langs) == 262 and model.points.shape[0] >= 262
    got = {r["doc_id"]: r for r in language_id.classify(docs, model).collect()}
    assert got[100]["lang_pred"] == "und" and got[101]["lang_pred"] != "und" and got[250]["lang_pred"] == "l50"
    for i, text, _ in rows[:20] + rows[62:70]:
        own = set(np.flatnonzero(language_id.presence(text)).tolist())
        marks = [set(np.flatnonzero(p).tolist()) for p in model.points]
        kernel = np.array([len(own & m) / math.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks])
        z = kernel @ model.weights
        p = np.exp(language_id.SHARPNESS * (z - z.max()))
        assert got[i]["lang_pred"] == model.langs[int(z.argmax())] and got[i]["score"] == pytest.approx(p.max() / p.sum()) and got[i]["strength"] == pytest.approx(min(1, max(0, z.max())))


def test_beginnings_and_misspellings_and_mentions():
    judge = toxicity.Judge(["idiot", "lowei*"])
    assert [judge.edits(t) for t in ("idiot", "idiott", "idoit", "lowei", "loweischaft", "lowe", "plowei", "x" * 99)] == [0, 1, -1, 0, 0, -1, -1, -1]
    exact, near, quoted, _, _ = judge.features('You idiot, you idiott. They said "what an idiot" and don\'t say it')
    assert exact == near == quoted == pytest.approx(np.log1p(1))


def test_cover_prefers_words_and_skips_their_beginnings():
    found = [{"idiot", "idio*", "idiot*", "rare"}] * 5 + [{f"lowei{i}", "lowei*", "lowe*"} for i in range(5)]
    weight = {t: 1.0 for s in found for t in s}
    chosen = toxicity.cover([set(s) for s in found], weight)
    assert "idiot" in chosen and "lowei*" in chosen and not {"idio*", "idiot*", "lowe*"} & set(chosen)


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 1, (400, 3)), rng.normal(2, 0.5, (600, 3))]
    model = quality.Discriminant(x, np.r_[np.zeros(400, int), np.ones(600, int)])
    z = (x - model.shift) / model.scale
    logs = []
    for m, f, share in zip(model.means, model.factors, (0.4, 0.6), strict=True):
        precision = f.T @ f
        d = z - m
        logs.append(np.log(share) + 0.5 * np.linalg.slogdet(precision)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, precision, d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))
