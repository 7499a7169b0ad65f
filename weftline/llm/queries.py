"""The queries of this folder's operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, license_scan, line_dedup, media, ngram_lm, oracle, quality, simhash, suffix_dedup, token_rollup
from weftline.llm.common import checkpoint, new_folder, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = ngram_lm.train(docs.where(~held_out))
    got = ngram_lm.score_texts(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line that isn't blank."""
    got = line_dedup.line_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "line_no", F.col("first_id").alias("first_doc_id"), "first_line", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, a second tokenizer version, the deletion of exact copies, a revision (the first version now counts an end), and a load that comes twice."""
    counts = checkpoint(token_rollup.word_counts(table(spark, sf_dir, "documents")))
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = checkpoint(counts.join(first, "digest").withColumn("copy", F.col("doc_id") > F.col("first_id")))
    one, two = F.col("words_v1"), F.col("words_v2")
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "token-counts"))
    rollup.commit("load", token_rollup.changes(marked, "insert", "words-v1", one))
    rollup.commit("second-version", token_rollup.changes(marked, "insert", "words-v2", two))
    copies = marked.where("copy")
    rollup.commit("deletions", token_rollup.changes(copies, "delete", "words-v1", one).unionByName(token_rollup.changes(copies, "delete", "words-v2", two)))
    rollup.commit("revision", token_rollup.changes(marked.where("not copy"), "revise", "words-v1", one + 1, one))
    rollup.commit("load", token_rollup.changes(marked, "insert", "words-v1", one))
    return rollup.totals()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_texts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.license_scan(table(spark, sf_dir, "documents"))
    joined = {k: F.array_join(k, ",").alias(k) for k in ("base_labels", "labels")}
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined["base_labels"], joined["labels"], "score", F.size("detections").cast("bigint").alias("n_detections"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_strings(table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_media": op4_media,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = oracle.SQL
