"""Language identification with string kernels.

k(x, y) is the normalised overlap of the sets of character 1-, 2- and 3-grams (a blended spectrum of presences, hashed
into DIM places). Landmarks from the labelled sample give a Nyström approximation; one-versus-rest kernel ridge
regression is solved in the span of the landmarks. Scoring is two matrix products for each batch of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, settled, slices

ORDERS, DIM = (1, 2, 3), 8192
#: Bounds of the labelled sample and of a language in it, and the least number of landmarks.
SAMPLE_ROWS, PER_LANGUAGE, LANDMARKS = 3_000, 600, 160
#: Rows that may be ranked for each that is wanted; more languages than this are joined without a broadcast.
SPARE, BROADCAST_LANGUAGES = 8, 100_000
RIDGE, SHARPNESS = 1e-3, 6.0
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 16


def presence(text: str) -> np.ndarray:
    """Which of the DIM places hold an n-gram of the text."""
    out = np.zeros(DIM, bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, max(1, len(points)), _CHUNK):
            part = points[at : at + _CHUNK + max(ORDERS) - 1]
            for n in ORDERS:
                if len(part) < n:
                    continue
                mixed = np.full(len(part) - n + 1, n, np.uint32)
                for k in range(n):
                    mixed = (mixed ^ part[k : len(part) - n + 1 + k]) * np.uint32(0x9E3779B1)
                out[(mixed ^ (mixed >> np.uint32(15))) & np.uint32(DIM - 1)] = True
    return out


def _presences(batches):
    for part in slices(batches):
        packed = [np.packbits(presence(t or "")).tobytes() for t in part.column(0).to_pylist()]
        yield pa.record_batch([pa.array(packed, pa.binary()), part.column(1)], ["grams", "lang"])


class Model:
    """Landmarks and one column of coefficients for each language."""

    def __init__(self, grams: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        n = len(langs)
        # Landmarks go round the languages so that a rare one has some.
        seen: dict[str, int] = {}
        turn = [seen.__setitem__(x, seen.get(x, 0) + 1) or seen[x] for x in langs]
        pick = sorted(range(n), key=lambda i: (turn[i], i))[: max(landmarks, 2 * len(self.langs))]
        self.points = np.unpackbits(grams[pick], axis=1).astype(np.float32)
        self.norms = np.sqrt(np.maximum(self.points.sum(1), 1))
        self.weights = np.zeros((len(pick), 0))
        if not n:
            return
        kernel = np.concatenate([self.kernel(np.unpackbits(grams[at : at + 256], axis=1).astype(np.float32)) for at in range(0, n, 256)])
        targets = np.array([[x == y for y in self.langs] for x in langs], float)
        # Languages weigh alike, however many rows they have.
        weight = np.array([n / (len(self.langs) * seen[x]) for x in langs])[:, None]
        inner = kernel[pick]
        left = kernel.T @ (kernel * weight) + ridge * n * (inner + inner.T) / 2 + 1e-6 * n * np.eye(len(pick))
        self.weights = np.linalg.solve(left, kernel.T @ (targets * weight))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1), 1))
        return (x @ self.points.T).astype(float) / (size[:, None] * self.norms[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The best language of each text, its share among all, and its own regression's output cut to 0 to 1."""
        names, scores, strength = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if known and self.langs:
            x = np.stack([presence(texts[i]) for i in known]).astype(np.float32)
            z = self.kernel(x) @ self.weights
            p = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            strength[known] = np.clip(z.max(1), 0, 1)
            for i, row in zip(known, p, strict=True):
                names[i], scores[i] = self.langs[int(row.argmax())], float(row.max())
        return names, scores, strength


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the rows with a language: per_language of each at most, sample_rows in all.

    Each language's rows are ranked by a hash of the id, and the sample takes every language's first, then every
    language's second, and so on; so no language is left out while there are at most sample_rows of them. Only ids are
    ranked, some SPARE * per_language of each language; what reaches the driver are n-gram sets.
    """
    rows = train.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    # Of a large language so few are let through by chance that no task ranks many, yet more than are wanted.
    sizes = settled(rows.groupBy("lang").agg(F.count("*").alias("n")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    chance = F.pmod(F.xxhash64(F.lit(7), "id", "print"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.join(sizes, "lang").where(chance * F.col("n") <= SPARE * per_language).drop("n")
    turn = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(5), "id"), "id", "print")
    ranked = rows.select("id", "lang", "print").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_language)
    picked = ranked.orderBy("turn", F.xxhash64(F.lit(6), "id"), "lang", "id", "print").limit(sample_rows).collect()
    if not picked:
        return Model(np.zeros((0, DIM // 8), np.uint8), [])
    spark = train.sparkSession
    # Bounded by sample_rows; rows that repeat id, text and language count once.
    chosen = spark.createDataFrame([tuple(r) for r in picked], ranked.schema).dropDuplicates(["id", "lang", "print"])
    both = rows.alias("r").join(F.broadcast(chosen.alias("c")), F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.print") == F.col("c.print")) & (F.col("r.lang") == F.col("c.lang")))
    sample = both.select("c.id", "r.text", "r.lang", "c.turn", "c.print").dropDuplicates(["id", "lang", "print"])
    got = sample.orderBy("turn", "lang", "id", "print").select("text", "lang").mapInArrow(_presences, "grams binary, lang string").collect()
    grams = np.frombuffer(b"".join(bytes(r["grams"]) for r in got), np.uint8).reshape(-1, DIM // 8)
    return Model(grams, [r["lang"] for r in got])


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns, lang_pred, score and strength (0 to 1); columns of these names in the input are replaced.

    score is the best language's share among all that were learned, strength its own regression's output, which doesn't
    depend on how many there are. Null text, and text without a letter (general category L), is ``und`` with 0 for both;
    so is every text where nothing was learned. Texts are read whole, however long. Rows that repeat give equal rows;
    an empty table gives none.
    """
    docs = docs.drop("lang_pred", "score", "strength")
    at, names = docs.columns.index(text_col), docs.columns
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = handle.value
        for part in slices(batches):
            langs, scores, strength = own.predict(part.column(at).to_pylist())
            yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(strength)], [*names, "lang_pred", "score", "strength"])

    return docs.mapInArrow(run, docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("strength", F.lit(0.0)).schema)


def predict_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, strength of every row; rows whose crc32(id) mod 4 is 2 teach nothing.

    A row with a null id is not held out and may teach; a null language teaches nothing. Null, empty, letterless, very
    long and repeated texts are as in classify. Ties go to the first language by name. An empty table gives no rows.
    """
    held = F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), text_col, label_col, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return classify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "strength")
