"""Cross-site boilerplate removal by the spread of lines over sites.

1. Every line with a word (trimmed) is keyed by two 64-bit hashes. HyperLogLog sketches of the sites per line are
   built in the scanning tasks and merged by aggregation, so a line that a third of all documents share is one small
   sketch per task.
2. Lines whose estimate is clearly above ``min_sites`` are boilerplate; lines near the threshold (within ``SIGMAS``
   standard errors, one site at least) get exact distinct counts; the others stay.
3. Boilerplate lines are removed from every document; the texts are joined once, on their id and hash, with the
   positions to remove.

Defined results: a null text stays null with no lines; a null site is a site of its own; blank lines are never
boilerplate and stay; a text of boilerplate only becomes its blank lines, or empty; repeated lines of one document
count once per site and are all removed; repeated documents are cleaned alike; an empty table gives an empty result;
other columns pass through,
but columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import SPACES, packed, staged, unpacked

MIN_SITES = 5
LOG2_BUCKETS = 12
SIGMAS = 4


def line_table(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """id, body (hash of the text), site, at, h1, h2: one row per line with a word."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    line = F.btrim("line", F.lit(SPACES))
    return (rows.withColumn("line", line).filter(F.col("line") != "")
            .select("id", "body", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log2_buckets: int = LOG2_BUCKETS) -> DataFrame:
    """h1, h2 of the lines that occur on at least min_sites sites."""
    error = SIGMAS * 1.04 / math.sqrt(2 ** log2_buckets)
    low, high = min(min_sites * (1 - error), min_sites - 1), max(min_sites * (1 + error), min_sites + 1)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_buckets))).alias("about"))
    spread = staged(spread.filter(F.col("about") >= low), "spread")
    sure = spread.filter(F.col("about") > high).select("h1", "h2")
    near = spread.filter(F.col("about") <= high).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").count()
             .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2"))
    return staged(sure.unionByName(exact), "boilerplate")


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
                       log2_buckets: int = LOG2_BUCKETS) -> DataFrame:
    """The documents with their cleaned text, n_lines (with a word) and n_removed."""
    lines = staged(line_table(docs, key, text, site), "lines")
    found = boilerplate(lines, min_sites, log2_buckets)
    # a document may repeat a boilerplate line thousands of times and may itself be repeated: positions are a set
    gone = (lines.join(found, ["h1", "h2"], "left_semi").groupBy(F.col("id").alias("_id"), F.col("body").alias("_body"))
            .agg(F.collect_set("at").alias("_gone")))
    whole = F.col("_doc")[text]
    own = packed(docs).withColumn("_hash", F.xxhash64(whole))
    out = own.join(gone, F.col("_doc")[key].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_body")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_every") - 1), F.col("_gone")), lambda i: F.get("_every", i))
    solid = F.size(F.filter("_every", lambda s: F.btrim(s, F.lit(SPACES)) != ""))
    out = out.withColumn("_every", F.coalesce(F.split(whole, "\n", -1), F.array().cast("array<string>")))
    out = out.withColumns({"n_lines": F.when(whole.isNull(), 0).otherwise(solid).cast("bigint"),
                           "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
                           "_clean": F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(kept, "\n"))})
    out = unpacked(out.withColumnRenamed("_clean", text), docs.columns, ["n_lines", "n_removed", text])
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def sql() -> str:
    """DuckDB SQL for op2 over the view documents: exact distinct counts throughout."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, text, source, row_number() OVER () AS rid, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, source, i, lines[i] AS raw, trim(lines[i], {spaces}) AS line
      FROM (SELECT rid, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES}),
m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line),
a AS (SELECT rid, count(*) FILTER (WHERE line <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
             string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS clean FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN n_removed > 0 THEN coalesce(clean, '') ELSE d.text END AS text
FROM d LEFT JOIN a USING (rid)"""
