"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import _shared, decontaminate, language_id, line_dedup, oracles, packing, preferences, secrets, simhash, token_files, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document (3-word shingles, 2 bits)."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_print().alias("fingerprint"), "component_id")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply, up to its last one, against the same with a stale last reply."""
    turns = _table(spark, sf_dir, "conversations")
    pairs = preferences.format_pairs(preferences.to_last_reply(turns), preferences.stale_replies(turns))
    spans = [preferences.spans_text(c).alias(c) for c in ("chosen_spans", "rejected_spans")]
    return pairs.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", *spans)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of them is held out of training."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    found = language_id.predict(rows, language_id.train(docs), carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of later repeated three-line windows."""
    found = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_lines", "n_removed")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or regression verdict on every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from ORC."""
    path = _shared.scratch_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(token_files.read(spark, path))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
}


def _spelled(rule: secrets.Rule) -> tuple[str, str, int, int, str]:
    """A rule for SQL, whose engine also folds letters beyond ASCII."""
    pattern = rule.pattern
    if rule.flags & re.IGNORECASE:
        words = "password passwd secret token api key".split()
        for word in words:
            pattern = re.sub(rf"(?<![A-Za-z]){word}(?![A-Za-z])", "".join(f"[{c.upper()}{c}]" for c in word), pattern)
    return rule.kind, pattern, rule.group, rule.least, rule.after_no


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scans": oracles.secret_scans([_spelled(r) for r in secrets.RULES], len(secrets.BASE_RULES)),
    "op3_exact_top_k": oracles.EXACT_TOP_K,
    "op4_chat_formatting": oracles.CHAT_FORMATTING,
    "op5_benchmark_decontamination": oracles.BENCHMARK_DECONTAMINATION,
    "op7_line_dedup": oracles.LINE_DEDUP,
}
