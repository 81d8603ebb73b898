"""A corpus pipeline of five operators.

Each stage reads what the stage before wrote and works on all of it.  Stages
but the last return the columns of ``documents``; the last returns the places
of all pieces in packed sequences.

A stage cuts its own lineage through tables in the shared folder, and so does
the writing of its result, so a lost executor costs the tasks it ran.

Defined results, for every stage: an empty table gives an empty one; rows may
repeat, and equal rows are judged alike (near-dedup keeps one of them); a null
or empty text has no language and goes with the first stage, and given to a
later one it has no line to lose, is a copy of other texts without words, holds
no benchmark window, and packs as its end id alone; null ids come last where
the order of ids decides; nulls in other columns, and columns beside those of
``documents``, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, language_id, line_dedup, near_copies, packing
from gristmill.llm._shared import row_key, scratch_path, written
from gristmill.shipping import ship


#: Languages to keep; None keeps every language that was learned.
LANGUAGES: tuple[str, ...] | None = None
#: The least score to keep: an even chance for the family and for the language in it.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: predicted, among ``LANGUAGES``, and by more than chance.

    Where no language can be learned, every document with a letter stays.
    """
    ship(spark)
    model = language_id.train(docs)
    learned = [lang for family in model.families for lang in family]
    found = language_id.predict(docs, model if learned else language_id.LETTERS)
    wanted = [lang for lang in learned if LANGUAGES is None or lang in LANGUAGES] if learned else ["any"]
    return found.filter(F.col("lang_pred").isin(wanted) & (F.col("score") > LEAST_SCORE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated three-line windows from the texts."""
    ship(spark)
    found = line_dedup.dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each group of near copies: five words, similarity 0.8 or more."""
    ship(spark)
    return near_copies.keep_first(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of a benchmark item, however long they are."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items).filter("n_hit > 0")
    bad = written(found.select("key"), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no tokenizer, language model or 64-bit fingerprint; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
