"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantoria.session import ensure_checkpoint_dir

#: a word is a maximal run of characters other than these (space, tab, line feed, VT, FF, carriage return)
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: the lineage ends there, so a lost executor
    costs only the tasks that read it, and several readers do not recompute it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Whole texts go to Python in Arrow batches of at most ``rows`` rows and about ``size`` bytes, unless the session
    sets a number itself."""
    for name, value in ((ROWS_PER_BATCH, rows), (BYTES_PER_BATCH, size)):
        spark.conf.set(name, spark.conf.get(name, str(value)))


def spread_key(*cols) -> Column:
    """32 hex digits that spread rows evenly and order them reproducibly (md5 of the key; null like empty)."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def numbered(df: DataFrame, group: list[str], levels: list[str], order: list, out: str) -> DataFrame:
    """0-based position of each row within ``group``, ordered by ``levels`` and then ``order``.

    No task sees a whole group: rows are numbered inside (group, levels) only, and the counts of the lower levels,
    which combine map-side, give each such cell its offset. ``group`` and ``levels`` must not be null; the last level
    should cut cells to a bounded size (e.g. a prefix of ``spread_key``)."""
    cells = df.groupBy(*group, *levels).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_at", F.lit(0).cast("bigint"))
    for i, level in enumerate(levels):
        above = group + levels[:i]
        sums = cells.groupBy(*above, level).agg(F.sum("_n").alias("_m"))
        before = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy(*above).orderBy(level).rowsBetween(Window.unboundedPreceding, -1) if above else before
        sums = sums.withColumn("_lower", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
        cells = cells.join(sums, [*above, level]).withColumn("_at", F.col("_at") + F.col("_lower")).drop("_lower")
    inside = Window.partitionBy(*group, *levels).orderBy(*order)
    return (df.join(cells.drop("_n"), [*group, *levels])
            .withColumn(out, F.col("_at") + F.row_number().over(inside) - 1).drop("_at"))


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one struct column _doc, so that added columns cannot clash with the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The packed columns and then the added ones; an added column replaces one of the same name."""
    return df.select(*[F.col("_doc")[c].alias(c) for c in columns if c not in added], *added)


def salted_lookup(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """Join of rows with a table on keys of which some may be a large part of all rows: the table stands once for every
    salt and rows take the salt of their partition, so such a key is shared by ``salts`` tasks."""
    left = rows.withColumn("_salt", F.spark_partition_id() % salts)
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
