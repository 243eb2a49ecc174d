"""Quality by regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal. A score is the logistic
of the classes' log-density difference: two Mahalanobis distances through Cholesky factors computed once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, slices

#: Bound of the labelled sample.
SAMPLE_ROWS = 8_000
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.1, 1e-3
THRESHOLD = 0.3
FEATURES = ["log_chars", "word_length", "word_spread", "capitals", "digits", "marks", "doubled_words", "top_word", "distinct_words", "bars", "line_repeats", "sentence_words", "mark_ends"]

_CLASS = np.zeros(256, np.uint8)
for _from, _to, _kind in ((48, 57, 1), (65, 90, 2), (97, 122, 3), (128, 255, 3), (33, 47, 4), (58, 64, 4), (91, 96, 4), (123, 126, 4)):
    _CLASS[_from : _to + 1] = _kind
_STOPS = b".!?"


def _logit(x: float, n: float) -> float:
    """Of a share x / n, held off its ends."""
    return float(np.log((x + 0.5) / (n - x + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5) if raw else np.zeros(5, np.int64)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    counts = Counter(words)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    stops = sum(raw.count(bytes([c])) for c in _STOPS)
    solid = int(kinds.sum())
    letters = int(kinds[2] + kinds[3])
    odd_ends = sum(w[-1] in b"!#$%&*+=@^~|<>" for w in counts.elements()) if n else 0
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(int(kinds[2]), letters),
        _logit(int(kinds[1]), solid),
        _logit(int(kinds[4]), solid),
        _logit(doubled, max(n - 1, 0)),
        _logit(max(counts.values(), default=0), n),
        _logit(len(counts), n),
        _logit(counts.get(b"|", 0), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log((n + 1) / (stops + 1))),
        _logit(odd_ends, n),
    ]


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.fitted:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.shift) / self.scale
        parts = [z[y == c] for c in (0, 1)]
        pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts) / len(z)
        self.means, self.factors, self.offsets = [], [], []
        for p in parts:
            own = (p - p.mean(0)).T @ (p - p.mean(0)) / len(p)
            mixed = (1 - TO_POOLED) * own + TO_POOLED * pooled
            mixed = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(len(mixed))
            factor = np.linalg.cholesky(mixed)
            self.means.append(p.mean(0))
            self.factors.append(np.linalg.inv(factor))
            self.offsets.append(np.log(len(p) / len(z)) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        bad, good = (o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def _measured(batches):
    for part in slices(batches):
        rows = [statistics(t) for t in part.column(0).to_pylist()]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), part.column(1)], ["x", "y"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, y of at most ``rows`` labelled documents, chosen by a hash of the id; use: which labels may teach."""
    picked = labels.where(F.col(label).isNotNull() & use).select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(8), "k"), "k", "y").limit(rows)
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "k").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, use, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    got = labelled_sample(docs, labels, "quality", use, sample_rows).mapInArrow(_measured, "x array<double>, y int").collect()
    return Discriminant(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], int))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose crc32(id) mod 5 is 0 teach nothing.

    Null text counts as empty and gets the score that its statistics give. Without labels of both kinds the score is
    the labels' mean, or 0.5. Labels without a document, and rows with a null id, teach nothing. Texts are read whole,
    however long; repeated rows get equal scores; an empty table gives no rows.
    """
    model = fit(docs, labels, crc_of_id(id_col) % 5 != 0)
    held = F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = handle.value
        for part in slices(batches):
            x = np.array([statistics(t) for t in part.column(2).to_pylist()]).reshape(part.num_rows, len(FEATURES))
            score = own.score(x)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
