"""Training-corpus pipeline: documents -> quality rules -> one of each near-duplicate class -> without benchmark
passages -> mixed to source weights -> shards. Every stage reads what the stage before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantoria.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from cantoria.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs.select(COLUMNS))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.one_of_each(docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times)."""
    docs = docs.select(COLUMNS)
    # rows are told apart by id and text, which are unique after the second stage; ids may be null or clash
    plan = mixing.mix_plan(docs, body="_body").groupBy(F.col("doc_id").alias("_id"), "_body").agg(F.max("copies").alias("copies")).filter("copies > 0")
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_body")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard."""
    return sharding.place(docs.select(COLUMNS), grown=None)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: alignment and similarity classes are beyond SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
