"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. The documents of a source are put in one fixed order
(size, then md5 of the key), their expected copies are summed up along it, one random offset per source is added and
a document is emitted once for each integer that its sum crosses. Ordering by size keeps the words taken within about
one document of the target, whatever the offset.

Sizes are words; targets share ``budget`` times all words by weight, stop at ``cap`` times their source's size, and
what is above is shared again by weight among the others (the water level is found in closed form over the table of
sources).

Defined results: a null text has size 0; a null source is a source of its own, ordered last; equal documents (even the
same id twice) are separate rows; a source with no words has target 0 and takes nothing; empty tables give empty
results; other columns are left alone by ``mix_plan`` users that join on the id. The offset and the order depend on
the seed, the source and the ids only, so reruns agree.

Scale: one pass over the texts writes (id, source, size); everything after works on these narrow rows. A hot source is
numbered in cells of (size, md5 prefix) whose counts combine map-side. Only the table of sources is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantoria.llm.common import WORD, numbered, spread_key, staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEED = 17


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target (water level: sum of min(cap * size, level * weight))."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(cap))
    # fill sources in the order in which a rising level reaches their cap
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (ranked.withColumn("before", F.coalesce(F.sum("full").over(lower), F.lit(0.0)))
              .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)))
              .withColumn("whole", F.sum("source_size").over(everything) * float(budget)))
    # the level if exactly the sources before this one are full
    level = (F.col("whole") - F.col("before")) / F.col("weight_left")
    ranked = ranked.withColumn("level", level)
    # the first source whose own cap lies above that level fixes it; if there is none, all are full
    fixed = F.min(F.when(F.col("full") / F.col("weight") >= F.col("level"), F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    ranked = ranked.withColumn("level", fixed["level"])
    return ranked.select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("level") * F.col("weight")), F.col("full")).alias("target"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
             budget: float = BUDGET, cap: float = CAP, seed: int = SEED, body: str | None = None) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies, and the hash of the text if ``body`` names it."""
    narrow = staged(docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        *([F.xxhash64(text).alias("_body")] if body else [])), "mix")
    plan = targets(narrow, weights, budget, cap)
    plan = plan.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_source"), "source_size", "target")
    md5 = spread_key("id")
    rows = narrow.withColumns({"cell": F.substring(md5, 1, 4), "order": md5})
    rows = numbered(rows, ["no_source", "src"], ["size", "cell"], ["order", "id"], "rank")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("src"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor((F.col("rank") + 1) * ratio + offset) - F.floor(F.col("rank") * ratio + offset)
    return (rows.join(plan, ["no_source", "src"])
            .select(F.col("id").alias(key), "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"),
                    *([F.col("_body").alias(body)] if body else [])))


def sql() -> str:
    """DuckDB SQL for op5 over the view documents."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
      FROM d GROUP BY source),
f AS (SELECT *, source_size * {float(CAP)}::DOUBLE AS full_size FROM s),
r AS (SELECT *, coalesce(sum(full_size) OVER lower_caps, 0) AS before,
             sum(weight) OVER () - coalesce(sum(weight) OVER lower_caps, 0) AS weight_left, sum(source_size) OVER () * {BUDGET}::DOUBLE AS whole
      FROM f WINDOW lower_caps AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (whole - before) / weight_left AS lvl FROM r),
g AS (SELECT min_by(lvl, full_size / weight) AS lvl FROM l WHERE full_size / weight >= lvl),
t AS (SELECT source, source_size, coalesce(least(full_size, g.lvl * weight), full_size) AS target FROM f LEFT JOIN g ON true),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS rank,
             ('0x' || substr(md5('{SEED}:' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS offs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       ((floor((rank + 1) * ratio + offs) - floor(rank * ratio + offs)) * size)::BIGINT AS taken,
       (floor((rank + 1) * ratio + offs) - floor(rank * ratio + offs))::BIGINT AS copies FROM k"""
