"""Human review sheets.

``read_reviews`` reads a set of review files whose columns differ (each file may carry only some label columns),
tags the origin from the file name and unions them by name; absent labels become 0.

``reviews_from_tables`` derives the review table from the driver's tables (FIXTURES.md §2): the verses (E1) of
every labelled document, six ordinal labels = the stand-in lexicon intensities of the line, ``es_util_real`` =
``labels.quality``; the file a row belongs to carries one dimension (doc_id % 6) and one origin (doc_id % 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantoria.fixed import DIMS, LABEL_COLS, STANDIN_LEXICON
from cantoria.functions.text import label_int
from cantoria.operators.lexicon import score_units
from cantoria.operators.units import SONG_KEYS, to_verses
from cantoria.sources.tables import songs, table

ORIGIN_KMEANS = "K-Means"
ORIGIN_REGEX = "Regex"


def read_reviews(spark: SparkSession, paths: list[str], fmt: str = "csv", marker: str = "v2") -> DataFrame:
    """Union review files by column name (missing columns -> null -> 0). The origin comes from the name of the path that
    was asked for, or, where that is a pattern, from the name of each file."""
    frames = []
    for p in paths:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
            if fmt == "csv" else spark.read
        df = reader.format(fmt).load(p)
        own = p.rstrip("/").rsplit("/", 1)[-1]
        marked = F.col("_metadata.file_name").contains(marker) if set(own) & set("*?[{") else F.lit(marker in own)
        df = df.withColumn("origen", F.when(marked, F.lit(ORIGIN_KMEANS)).otherwise(F.lit(ORIGIN_REGEX)))
        frames.append(df)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c in LABEL_COLS:
        out = out.withColumn(c, label_int(c)) if c in out.columns else out.withColumn(c, F.lit(0))
    return out


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' verses with labels (all six), origin, file dimension and the usefulness verdict."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("song_id"), "quality", "toxic")
    v = to_verses(songs(spark, sf_dir).join(lab, "song_id"), keys=SONG_KEYS + ["quality", "toxic"])
    scored = score_units(v, STANDIN_LEXICON)
    for d in DIMS:
        scored = scored.withColumnRenamed(f"intensidad_{d}", f"val_{d}")
    dim_of = F.element_at(F.array(*[F.lit(d) for d in DIMS]), (F.col("song_id") % 6 + 1).cast("int"))
    return (scored
            .withColumn("origen", F.when(F.col("song_id") % 2 == 1, F.lit(ORIGIN_KMEANS)).otherwise(F.lit(ORIGIN_REGEX)))
            .withColumn("dim_archivo", dim_of)
            .withColumn("es_util_real", F.col("quality").cast("int")))


def reviews_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over the derived sheets. Each file carries only its own dimension's label column; the union of the six
    files by name (absent labels -> 0) equals one projection keeping the row's own dimension, so the corpus is
    scanned once instead of once per file."""
    rows = review_rows(spark, sf_dir)
    base = ["song_id", "artist", "song", "year", "verso_idx", "verso_texto", "origen"]
    return rows.select(*base, *[F.when(F.col("dim_archivo") == d, F.col(f"val_{d}")).otherwise(F.lit(0))
                                .cast("int").alias(f"val_{d}") for d in DIMS])
