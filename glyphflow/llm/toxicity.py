"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

The lexicon (words, and word beginnings that a language inflects) is chosen by greedy cover of the labelled toxic
documents. A token becomes a Levenshtein automaton, run bit-parallel along the lexicon's trie, which finds the entries
it spells or misspells. Each hit is judged in its window: inside quotation marks or between words that learned windows
show to be harmless, it counts as mention, otherwise as abuse. A small logistic model turns the counts into a score.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, settled, slices
from .quality import labelled_sample

#: Bound of the labelled documents learned from; terms, entries and context words are all that these give.
SAMPLE_ROWS = 10_000
MIN_DOCS, MIN_RATIO, COVER = 3, 8.0, 3
PREFIXES = (4, 5, 6)
WINDOW = 5
THRESHOLD = 0.7
FEATURES = ["exact", "misspelled", "mentioned", "density", "context"]
_TOKEN = re.compile(r"\w+")
#: Scripts that write words without spaces between them; their runs are read as overlapping pairs of characters.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
#: Marks that open or close a quotation.
QUOTES = "\"'“”„‟«»‹›‘’‚`"
_MEMO = 400_000


def tokens_of(text: str) -> list[str]:
    """The lower-cased words; pairs of neighbouring characters where a script writes no spaces."""
    found = _TOKEN.findall(text.lower())
    if text.isascii() or not _UNSPACED.search(text):
        return found
    return [part for word in found for part in _parts(word)]


def _parts(word: str) -> list[str]:
    out, at = [], 0
    for m in _UNSPACED.finditer(word):
        if at < m.start():
            out.append(word[at : m.start()])
        run, at = m.group(), m.end()
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out + [word[at:]] * (at < len(word))


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Entries: a word, or a beginning (written with * at its end)."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.root: dict = {}
        for number, entry in enumerate(entries):
            node = self.root
            for c in entry.rstrip("*"):
                node = node.setdefault(c, {})
            node.setdefault("", []).append((number, entry.endswith("*")))

    def match(self, token: str, keep_first: bool = True) -> list[tuple[int, int]]:
        """(entry, edits) for each entry that the token spells within the entry's edits; beginnings match exactly.

        keep_first: only entries that begin with the token's first letter.
        """
        n = len(token)
        most = allowed_edits(n + 1)
        at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(token):
            at[c] |= 1 << i
        end = 1 << n
        # state[k]: token positions that k edits can have reached.
        first = [(1 << (k + 1)) - 1 & (end << 1) - 1 for k in range(most + 1)]
        best: dict[int, int] = {}
        stack = [(self.root, first, 0)]
        while stack:
            node, state, depth = stack.pop()
            for number, open_ended in node.get("", ()):
                if open_ended:
                    if state[0] >> depth & 1 and depth <= n:
                        best[number] = 0
                    continue
                for k in range(min(most, allowed_edits(depth)) + 1):
                    if state[k] & end:
                        best[number] = min(best.get(number, k), k)
                        break
            for c, below in node.items():
                if not c:
                    continue
                step = []
                for k in range(most + 1):
                    reach = (state[k] & at.get(c, 0)) << 1
                    if k:
                        # an extra letter in the entry, another letter, an extra letter in the token
                        reach |= state[k - 1] | state[k - 1] << 1 | step[k - 1] << 1
                    step.append(reach & (end << 1) - 1)
                if step[-1] and (depth or not keep_first or (n and token[0] == c)):
                    stack.append((below, step, depth + 1))
        return list(best.items())


class Pieces:
    """Whether a token can spell one of the words at all: of a word cut in one piece more than it may have edits, one piece
    stands in the token unchanged, moved by no more places than there are edits."""

    def __init__(self, words: list[str]):
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for w in words:
            most = allowed_edits(len(w))
            cuts = [len(w) * i // (most + 1) for i in range(most + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.places[w[a:b]].append((a - most, a + most))
        self.sizes = sorted({len(p) for p in self.places})

    def allow(self, token: str) -> bool:
        for size in self.sizes:
            for at in range(len(token) - size + 1):
                for low, high in self.places.get(token[at : at + size], ()):
                    if low <= at <= high:
                        return True
        return False


def _terms(text: str) -> set[str]:
    words = set(tokens_of(text))
    out = set(words)
    for w in words:
        out.update(w[:k] + "*" for k in PREFIXES if len(w) >= k)
    return out


def _count_terms(batches):
    toxic, clean, docs = Counter(), Counter(), [0, 0]
    for part in slices(batches):
        for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            docs[y == 1] += 1
            (toxic if y == 1 else clean).update(_terms(text or ""))
            if len(toxic) + len(clean) > 500_000:
                yield _counted(toxic, clean, [0, 0])
                toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean, docs)


def _counted(toxic: Counter, clean: Counter, docs: list[int]) -> pa.RecordBatch:
    terms = [*(toxic.keys() | clean.keys()), None]
    return pa.record_batch([pa.array(terms, pa.string()), pa.array([toxic[t] if t is not None else docs[1] for t in terms], pa.int64()), pa.array([clean[t] if t is not None else docs[0] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def cover(found: list[set[str]], weight: dict[str, float], times: int = COVER) -> list[str]:
    """Greedy choice of terms until every document that can be is covered ``times`` times.

    A term and its beginnings never both enter: what they would cover is the same.
    """
    holders: dict[str, list[int]] = defaultdict(list)
    for i, terms in enumerate(found):
        for t in terms:
            holders[t].append(i)
    need = [times] * len(found)
    gain = {t: len(own) * weight[t] for t, own in holders.items()}
    chosen: list[str] = []
    # Of terms that cover the same, the longest: a whole word before its beginning. Gains only fall, so a term whose gain
    # still is what it was when it was put in line is the best.
    rank = lambda x: (-round(gain[x], 9), -len(x.rstrip("*")), x.endswith("*"), [-ord(c) for c in x])
    line = [(rank(t), t) for t in gain]
    heapq.heapify(line)
    while line:
        was, t = heapq.heappop(line)
        if was != (now := rank(t)):
            heapq.heappush(line, (now, t))
            continue
        if gain[t] < MIN_DOCS * 0.5:
            break
        del gain[t]
        if any(t.rstrip("*").startswith(c.rstrip("*")) or c.rstrip("*").startswith(t.rstrip("*")) for c in chosen):
            continue
        chosen.append(t)
        for i in holders[t]:
            need[i] -= 1
            if need[i] == 0:
                for other in found[i]:
                    if other in gain:
                        gain[other] -= weight[other]
    return chosen


class Judge:
    def __init__(self, entries: list[str]):
        self.trie = Trie(entries)
        self._filter()
        self.harmless: set[str] = set()
        self.context: dict[str, float] = {}
        self.weights = np.array([-3.0, 3.0, 1.0, -1.0, 0.0, 0.0])
        self.memo: dict[str, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "near": {}}

    def __setstate__(self, state):
        self.__dict__ = state

    def _filter(self) -> None:
        entries = self.trie.entries
        self.words = [e for e in entries if not e.endswith("*")]
        self.beginnings = tuple(e.rstrip("*") for e in entries if e.endswith("*"))
        #: By a token's length: the words that it can spell, as pieces and as a trie.
        self.near: dict[int, tuple[Pieces, Trie] | None] = {}

    def _near(self, n: int) -> tuple[Pieces, Trie] | None:
        words = [w for w in self.words if abs(len(w) - n) <= min(allowed_edits(len(w)), allowed_edits(n + 1))]
        self.near[n] = out = (Pieces(words), Trie(words)) if words else None
        return out

    def edits(self, token: str) -> int:
        """Least edits to an entry; -1 for no entry."""
        got = self.memo.get(token)
        if got is not None:
            return got
        if len(self.memo) > _MEMO:
            self.memo.clear()
        got, n = -1, len(token)
        if token.startswith(self.beginnings):
            got = 0
        else:
            near = self.near[n] if n in self.near else self._near(n)
            if near and near[0].allow(token):
                got = min((k for _, k in near[1].match(token, keep_first=False)), default=-1)
        if got > 0 and token in self.harmless:
            got = -1
        self.memo[token] = got
        return got

    def hits(self, text: str) -> tuple[list[tuple[str, int, bool, list[str]]], int]:
        """(token, edits, quoted, window words) of each hit, and the number of tokens."""
        tokens = tokens_of(text)
        edits = self.edits
        told = {t: edits(t) for t in set(tokens)}
        if max(told.values(), default=-1) < 0:
            return [], len(tokens)
        at = [i for i, t in enumerate(tokens) if told[t] >= 0]
        marks = _quoted(text.lower()) if any(q in text for q in QUOTES) else set()
        return [(tokens[i], told[tokens[i]], i in marks, tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]) for i in at], len(tokens)

    def features(self, text: str | None) -> list[float]:
        found, n = self.hits(text or "")
        exact = sum(k == 0 and not q for _, k, q, _ in found)
        near = sum(k > 0 and not q for _, k, q, _ in found)
        quoted = sum(q for _, _, q, _ in found)
        windows = [np.mean([self.context.get(w, 0.0) for w in words]) if words else 0.0 for _, _, q, words in found if not q]
        return [float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(quoted)), float(np.log1p(100 * (exact + near) / max(n, 1))), float(np.mean(windows)) if windows else 0.0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _quoted(text: str) -> set[int]:
    """Numbers of the tokens between an opening and a closing mark of one line; an apostrophe in a word is no mark."""
    out, number = set(), 0
    for line in text.split("\n"):
        opened: list[int] | None = None
        for m in re.finditer(r"\w+|[" + re.escape(QUOTES) + "]", line):
            c = m.group()
            if c in QUOTES and len(c) == 1:
                sides = line[m.start() - 1 : m.start()] + line[m.end() : m.end() + 1]
                if len(sides) == 2 and sides.isalnum() and not _UNSPACED.search(sides):
                    continue
                if opened is None:
                    opened = []
                else:
                    out.update(opened)
                    opened = None
            else:
                for _ in _parts(c) if not c.isascii() and _UNSPACED.search(c) else (c,):
                    if opened is not None:
                        opened.append(number)
                    number += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Bias and weights by Newton steps; the ridge leaves the bias alone."""
    full = np.c_[np.ones(len(x)), x]
    w = np.zeros(full.shape[1])
    keep = ridge * len(x) ** 0.5 * np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(w)), full.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, use, sample_rows: int = SAMPLE_ROWS) -> Judge:
    """Lexicon, harmless look-alikes, context words and model from a bounded sample of labelled documents."""
    sample = settled(labelled_sample(docs, labels, "toxic", use, sample_rows))
    counts = settled(sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = counts.where("term IS NULL").first()
    if not total or not total["toxic"] or not total["clean"]:
        return Judge([])
    ratio = ((F.col("toxic") + 0.5) / (total["toxic"] + 1)) / ((F.col("clean") + 0.5) / (total["clean"] + 1))
    good = counts.where(F.col("term").isNotNull() & (F.col("toxic") >= MIN_DOCS) & (ratio >= MIN_RATIO))
    # All that the bounded sample gives.
    top = good.collect()
    weight = {r["term"]: r["toxic"] / (r["toxic"] + r["clean"]) for r in top}

    def held(batches):
        for part in slices(batches):
            yield pa.record_batch([pa.array([sorted(_terms(t or "") & weight.keys()) for t in part.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

    found = [set(r["terms"]) for r in sample.where("y = 1").select("text").mapInArrow(held, "terms array<string>").collect()]
    judge = Judge(cover(found, weight))
    _learn_context(judge, sample)
    # The harmless look-alikes come from one half of the sample and the model from the other, as it will meet new ones.
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    judge.harmless = _look_alikes(judge, sample.where(half == 0))

    def measured(batches):
        for part in slices(batches):
            yield pa.record_batch([pa.array([judge.features(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    got = sample.where(half == 1).select("text", "y").mapInArrow(measured, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float)
    if 0 < y.sum() < len(y):
        judge.weights = logistic(x, y)
    judge.harmless |= _look_alikes(judge, sample.where(half == 1))
    return judge


def _look_alikes(judge: Judge, sample: DataFrame) -> set[str]:
    """Tokens of clean documents that spell an entry only with edits."""

    def run(batches):
        for part in slices(batches):
            seen = {w for t in part.column(0).to_pylist() for w in set(tokens_of(t or "")) if judge.edits(w) > 0}
            yield pa.record_batch([pa.array(sorted(seen), pa.string())], ["w"])

    return {r["w"] for r in sample.where("y = 0").select("text").mapInArrow(run, "w string").distinct().collect()}


def _learn_context(judge: Judge, sample: DataFrame) -> None:
    def run(batches):
        for part in slices(batches):
            rows = [(w, y) for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in {w for *_, q, words in judge.hits(t or "")[0] if not q for w in words}]
            yield pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], ["w", "y"])

    seen = sample.select("text", "y").mapInArrow(run, "w string, y int").groupBy("w").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    top = seen.where("n >= 2").collect()
    toxic, n = sum(r["toxic"] for r in top) + 1, sum(r["n"] for r in top) + 2
    base = np.log(toxic / (n - toxic)) if top else 0.0
    judge.context = {r["w"]: float(np.log((r["toxic"] + 2 * toxic / n) / (r["n"] - r["toxic"] + 2 * (n - toxic) / n)) - base) for r in top}


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose crc32(id) mod 3 is 1 teach nothing.

    Null text counts as empty: it has no hit, so it gets the model's base score. Texts are read whole, however long;
    repeated rows get equal scores; an empty table gives no rows. Without toxic and clean labels the lexicon is empty and
    every score low. Labels without a document, and rows with a null id, teach nothing.
    """
    judge = fit(docs, labels, crc_of_id(id_col) % 3 != 1)
    held = F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))
    handle = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        own = handle.value
        for part in slices(batches):
            score = own.score(np.array([own.features(t) for t in part.column(2).to_pylist()]).reshape(part.num_rows, len(FEATURES)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
