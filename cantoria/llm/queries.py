"""Registered queries of the training-data operators: each applies its operator with production parameters to the
whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cantoria.llm import (decontaminate, jaccard_join, lexical_search, line_dedup, mixing, neighbours, pii, prefix_trie, quality_rules, repeats,
                          sharding, url_filter, warc)
from cantoria.llm.common import table


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "n_lines", "n_stop", "n_capitals", "n_bangs", "failed_rules")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_join(table(spark, sf_dir, "documents"))


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_table(spark, warc.write_pages(table(spark, sf_dir, "pages")))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    out = neighbours.quality_scores(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark)).drop("url")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_line_dedup": op2_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op5_source_mixing": op5_source_mixing,
    "op6_rendezvous_sharding": op6_rendezvous_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_warc_roundtrip": op9_warc_roundtrip,
    "op10_neighbour_quality": op10_neighbour_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filters": op12_url_filters,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_line_dedup": line_dedup.sql(),
    "op3_quality_rules": quality_rules.sql(),
    "op5_source_mixing": mixing.sql(),
    "op9_warc_roundtrip": warc.sql(),
    "op11_prefix_trie": prefix_trie.sql(),
    "op12_url_filters": url_filter.sql(),
    "op13_lexical_search": lexical_search.sql(),
}
