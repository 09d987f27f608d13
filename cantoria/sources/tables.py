"""Corpus readers with explicit schemas, and the ``songs`` view over the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SONGS_SCHEMA = T.StructType([
    T.StructField("song_id", T.LongType()),
    T.StructField("artist", T.StringType()),
    T.StructField("album", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("song", T.StringType()),
    T.StructField("lyrics", T.StringType()),
])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_songs(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = SONGS_SCHEMA) -> DataFrame:
    """Read a song table; CSV with header, BOM and multi-line quoted lyrics is supported. CSV columns are taken by
    their header names, in any order; where the file has no ``song_id``, rows are numbered in reading order (unique
    and increasing, not gapless). Rows with null lyrics are dropped. Text ``nan`` years are kept as text; coercion
    happens at use (P10)."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
        missing = [f.name for f in schema if f.name not in raw.columns and f.name != "song_id"]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        number = F.monotonically_increasing_id()
        df = raw.select(*[(F.col(f.name) if f.name in raw.columns else number).cast(f.dataType).alias(f.name) for f in schema])
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return df.dropna(subset=["lyrics"])


def songs_from_documents(documents: DataFrame) -> DataFrame:
    """The ``songs`` view over the driver's ``documents`` table (mapping documented in FIXTURES.md §2):
    song_id = doc_id, artist = source (upper-cased on the planted duplicates, whose title repeats the song 20
    ids earlier), year cycling 1970-2029 with 'Desconocido' every 50th id, album from the id, lyrics = text."""
    d = F.col("doc_id")
    dup = (d % 200) >= 180
    return (documents
            .where(F.col("text").isNotNull())
            .select(
                d.alias("song_id"),
                F.when(dup, F.upper("source")).otherwise(F.col("source")).alias("artist"),
                F.concat(F.lit("Album "), (d % 7).cast("string")).alias("album"),
                F.when(d % 50 == 49, F.lit("Desconocido"))
                 .otherwise((F.lit(1970) + (d * 7) % 60).cast("string")).alias("year"),
                F.concat(F.lit("Canción "), F.when(dup, d - 20).otherwise(d).cast("string")).alias("song"),
                F.col("text").alias("lyrics"),
                F.col("lang"),
            ))


SPREAD_KEY = "spark.cantoria.spreadPartitions"


def spread_scan(df: DataFrame) -> DataFrame:
    """CPU-heavy text work runs per input split; splits are sized by spark.sql.files.maxPartitionBytes. A session that
    reads files which cannot be split (one row group) may ask for a round-robin exchange of the rows by setting
    SPREAD_KEY to a number of partitions; without it no scan is ever shuffled."""
    n = df.sparkSession.conf.get(SPREAD_KEY, None)
    return df.repartition(int(n)) if n else df


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return songs_from_documents(spread_scan(table(spark, sf_dir, "documents")))


# SQL twin of ``songs_from_documents`` for the DuckDB oracle.
SONGS_SQL = """
SELECT doc_id AS song_id,
       CASE WHEN doc_id % 200 >= 180 THEN upper(source) ELSE source END AS artist,
       'Album ' || CAST(doc_id % 7 AS VARCHAR) AS album,
       CASE WHEN doc_id % 50 = 49 THEN 'Desconocido' ELSE CAST(1970 + (doc_id * 7) % 60 AS VARCHAR) END AS year,
       'Canción ' || CAST(CASE WHEN doc_id % 200 >= 180 THEN doc_id - 20 ELSE doc_id END AS VARCHAR) AS song,
       text AS lyrics,
       lang
FROM documents WHERE text IS NOT NULL
"""
