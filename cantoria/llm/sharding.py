"""Sharding by rendezvous (highest random weight) hashing of a stable record key over weighted shards.

A record goes to the shard with the greatest score -weight / ln(u), u a uniform number hashed from (key, shard).
A shard added at the end takes only the records whose score it tops; no record moves between the old shards.

Defined results: a null key hashes like the empty string; a null text has no bytes (size 8, checksum 0); rows with the
same key go to the same shard, one slot each; ties between shards go to the greater shard number; an empty table gives
an empty result; other columns pass through, but ``place`` replaces columns with the names of its results.

Scale: placing is a projection in the record's row. Slots are numbered in cells of (shard, md5 prefix of the key)
whose counts combine map-side, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import numbered, packed, spread_key, staged, unpacked

SHARDS = 24


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u in (0, 1) from the first 48 bits of md5(key:shard)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((bits + 0.5) / float(1 << 48))


def _best(key: Column, weights: list[float]) -> Column:
    return F.array_max(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))


def place(rows: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown_weight: float = 1.0,
          shard: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """Adds the shard and, if asked for, the shard with one more shard of grown_weight."""
    weights = weights or [1.0] * SHARDS
    bound = packed(rows).withColumn("_key", F.coalesce(F.col("_doc")[key].cast("string"), F.lit("")))
    bound = bound.withColumn("_best", _best(F.col("_key"), weights))
    out = bound.withColumn(shard, F.col("_best")["shard"])
    if grown:
        n = len(weights)
        more = F.struct(_score(F.col("_key"), n, grown_weight).alias("score"), F.lit(n).alias("shard"))
        out = out.withColumn(grown, F.greatest(F.col("_best"), more)["shard"])
    return unpacked(out, rows.columns, [shard, grown] if grown else [shard])


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("id"), (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    placed = staged(place(narrow, "id", weights).withColumn("order", spread_key("id")).withColumn("cell", F.substring("order", 1, 4)), "shard")
    slots = numbered(placed, ["shard"], ["cell"], ["order", "id", "size", "text_crc32"], "slot")
    return slots.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
