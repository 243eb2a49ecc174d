"""The corpus pipeline: documents in, packed training sequences out.

Stages, each on all that its predecessor kept: language ID, line dedup, SimHash near-dedup, mixing of the sources, and
best-fit packing. All but the last return the columns of documents, whatever further columns there are and whatever they
are called. Null and empty texts, rows without an id, repeated rows and empty tables are as the stages say; texts are
taken whole, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import language_id, line_dedup, mixing, near_text, packing, simhash
from glyphflow.llm.common import apart, crc_of_id, removed, settled, shared_folder, together

#: Documents whose best language has a weaker regression output than this are rejected, like those without a letter.
MIN_STRENGTH = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language: no letter (null and empty texts too), or no language likely enough.

    The model learns from the documents' own lang column, but not from those held out for op5. Where no document has a
    language nothing can be learned, every text is undetermined and none stays. Repeated rows share their fate, a null id
    changes nothing, and an empty table stays empty.
    """
    model = language_id.fit(docs.where(F.coalesce(crc_of_id("doc_id") % 4 != 2, F.lit(True))))
    told = language_id.classify(apart(docs, text="text"), model)
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("strength") >= MIN_STRENGTH)).select(*together(docs, text=F.col("text")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand in three documents or more out of all but the last; every document stays.

    A null text comes back empty. n_chars, where there is such a column, counts the text that stays. Rows without an id
    keep a line only where no row with an id holds it; an empty table stays empty.
    """
    cut = line_dedup.dedup_lines(apart(docs, doc_id="doc_id", text="text"))
    return cut.select(*together(docs, doc_id=F.col("doc_id"), text=F.col("text"), n_chars=F.length("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id (a row without an id only where its group has none).

    Groups are those whose fingerprints, as op4 defines them, link; of what stays, those that five-word similarity of 0.8
    or more links, for which op4's fingerprints differ in too many bits. Texts without words are one group; of repeated
    rows one stays; an empty table stays empty.
    """
    # Written out between, as the second pass reads the texts several times.
    return near_text.keep_one_similar(settled(simhash.keep_one(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of lesser sources up to MAX_REPEATS times on average.

    A null source is a source of its own, null text has no tokens; rows that repeat are mixed as rows; an empty table
    stays empty.
    """
    own = ("doc_id", "source", "text")
    return mixing.mix(apart(docs, **{c: c for c in own})).select(*together(docs, **{c: F.col(c) for c in own}))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and their places in sequences of 1024 tokens; every row has a piece, whatever its text and id."""
    return packing.pack(docs.select("doc_id", "text")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language ID and packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents.

    Each stage's result is a table in the shared folder; it goes when the next one stands, so only the last stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            removed(spark, before)
        before = f"{home}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
