"""Dedupe, context windows, quota samples and seeded (hash-ordered) sampling.

Random draws are replaced by md5 ordering of (key, seed): results do not depend on partitioning or retries,
and Spark and DuckDB compute the same md5.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantoria.fixed import DIVERSE_TARGET, LABEL_COLS, SEED
from cantoria.functions.text import collapse_ws, py_strip


def hash_key(*cols, seed: int = SEED) -> Column:
    """md5 hex of the key columns and the seed joined by '|': a reproducible random order."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def dedupe(df: DataFrame, key, order: list[str], last: bool = False, method: str = "join") -> DataFrame:
    """Keep the first row (smallest ``order``; ``last``: largest) per key; null keys form no group.
    ``order`` must identify a row within its key (e.g. a document id).

    ``join`` (for table scans): full rows (with their text) are never sorted or held in aggregation buffers.
    1. winners = (key, min(order)) — a small hash aggregate, combined map-side, so a key holding a third of all
       rows is reduced to one row per task before the shuffle;
    2. rows are semi-joined to the winners on the key alone (the winners are already partitioned by it) with a
       shuffled hash join — winners are the build side, the corpus is streamed, never sorted, and AQE can split
       a skewed key on the streamed side. The order match is a residual join condition.
    The input is read twice, so use it on scans (the winners branch reads only the key's columns).

    ``window`` (for derived inputs such as exploded units): one pass, ``row_number() = 1`` per key — the
    upstream is evaluated once and the rows are sorted once on the reduce side."""
    kcol = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_k", kcol).where(F.col("_k").isNotNull())
    # a single order column stays a plain (fixed-width) value so the winners aggregate is a hash aggregate
    ordc = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    if method == "window":
        w = Window.partitionBy("_k").orderBy(*[F.desc(c) if last else F.asc(c) for c in order])
        return keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_k", "_r")
    pick = F.max if last else F.min
    winners = keyed.groupBy(F.col("_k").alias("_wk")).agg(pick(ordc).alias("_o"))
    # coalesce(...) keeps the order match out of the equi-join keys, so only the key drives partitioning
    cond = (F.col("_k") == F.col("_wk")) & F.coalesce(ordc == F.col("_o"), F.lit(False))
    return keyed.join(winners.hint("shuffle_hash"), cond, "left_semi").drop("_k")


def neighbour_context(df: DataFrame, keys=("artist", "song"), order=("song_id", "verso_idx"),
                      text_col: str = "verso_texto", radius: int = 1) -> DataFrame:
    """W1 (pool scope): previous + current + next unit inside the given (filtered) table per song; missing
    neighbours are ''; the result is stripped with whitespace runs collapsed (not lower-cased). Units with a null key
    belong to no song: each is alone, so they neither see each other nor meet in one task."""
    unkeyed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    alone = F.when(unkeyed, F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    w = Window.partitionBy(*keys, alone).orderBy(*order)
    parts = [F.coalesce(F.lag(text_col, i).over(w), F.lit("")) for i in range(radius, 0, -1)]
    parts += [F.col(text_col)]
    parts += [F.coalesce(F.lead(text_col, i).over(w), F.lit("")) for i in range(1, radius + 1)]
    ctx = F.concat_ws(" ", *parts)
    return df.withColumn("texto_contexto", collapse_ws(ctx, lower=False))


def neighbour_context_inline(verses: Column, radius: int = 1) -> Column:
    """W1 (lyric scope, default): neighbours taken from the full line list of the same song row — a
    projection, no window. ``verses`` is an array<struct<verso_idx, verso_texto>> from units.verse_array."""
    return F.transform(verses, lambda v, i: F.struct(
        v["verso_idx"].alias("verso_idx"), v["verso_texto"].alias("verso_texto"),
        collapse_ws(F.array_join(F.transform(
            F.slice(verses, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1),
            lambda x: x["verso_texto"]), " "), lower=False).alias("texto_contexto")))


def quota_sample(df: DataFrame, group_col: str, item_col: str, unit_col: str, unit_order: str,
                 per_group: int = 50, per_item: int = 2, seed: int = SEED) -> DataFrame:
    """W3 in exact set form: in each item the first ``per_item`` distinct units; items visited in hash order
    within their group; stop at ``per_group`` units per group. Two ranked windows, each bounded: per item
    (one song's units) and per group (``WindowGroupLimit`` prunes to ``per_group`` rows per task first)."""
    distinct_units = dedupe(df, F.concat_ws("\u0001", F.col(item_col).cast("string"), F.col(unit_col)),
                            [item_col, unit_order], method="window")
    w_item = Window.partitionBy(item_col).orderBy(unit_order)
    firsts = distinct_units.withColumn("_r", F.row_number().over(w_item)).where(F.col("_r") <= per_item)
    w_grp = Window.partitionBy(group_col).orderBy(hash_key(item_col, seed=seed), F.col(item_col), F.col("_r"))
    return firsts.withColumn("_g", F.row_number().over(w_grp)).where(F.col("_g") <= per_group).drop("_r", "_g")


def sample_units(df: DataFrame, item_col: str, unit_col: str, n_items: int, per_item: int = 1,
                 seed: int = SEED) -> DataFrame:
    """``n_items`` items in seeded hash order (a sampling limit: the feature), then ``per_item`` units of
    each in hash order."""
    items = (df.select(item_col).distinct().orderBy(hash_key(item_col, seed=seed), item_col).limit(n_items))
    w = Window.partitionBy(item_col).orderBy(hash_key(item_col, unit_col, seed=seed), unit_col)
    return (df.join(items, item_col, "left_semi").withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= per_item).drop("_r"))


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED, by: str | None = None) -> DataFrame:
    """min(n, rows) rows without replacement in seeded hash order (per ``by`` group when given)."""
    h = hash_key(*key_cols, seed=seed)
    if by is None:
        return df.orderBy(h, *key_cols).limit(n)
    w = Window.partitionBy(by).orderBy(h, *key_cols)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def review_sheet(df: DataFrame, cols: list[str], extra: list[str] | None = None) -> DataFrame:
    """T4: the sample plus six empty label columns in a fixed order."""
    return df.select(*cols, *(extra or []), *[F.lit(None).cast("int").alias(c) for c in LABEL_COLS])


def ordered_distinct_units(units: Column) -> Column:
    """Distinct units of a document in first-seen order (``array_distinct`` keeps order)."""
    return F.array_distinct(units)


def stratified_split(df: DataFrame, label_cols: list[str], test_frac: float = 0.2, seed: int = SEED,
                     id_col: str = "id") -> DataFrame:
    """M8: key = labels joined by '_'; combinations that occur once are pooled as 'rare_combination' and split like
    any other stratum. The test part has ceil(frac * rows) rows: every stratum gives floor(frac * n), and the strata
    with the largest remainders give one more. Within a stratum rows are taken in hash order (60 bits), numbered in ranges, so no
    stratum is sorted in one task; the table of strata (at most the label combinations) is."""
    keyed = df.withColumn("_key", F.concat_ws("_", *[F.col(c).cast("string") for c in label_cols]))
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("estrato", F.when(F.col("_n") == 1, F.lit("rare_combination")).otherwise(F.col("_key")))
    strata = sizes.groupBy("estrato").agg(F.sum("_n").alias("_n"))
    part = F.lit(float(test_frac)) * F.col("_n")
    every = Window.partitionBy()
    strata = strata.select("estrato", "_n", F.floor(part).alias("_low"), (part - F.floor(part)).alias("_rest"))
    more = F.ceil(F.lit(float(test_frac)) * F.sum("_n").over(every)) - F.sum("_low").over(every)
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), "estrato"))
    strata = strata.select("estrato", (F.col("_low") + (turn <= more).cast("int")).alias("_quota"))
    from cantoria.operators.stats import row_index
    first = F.conv(F.substring(hash_key(id_col, seed=seed), 1, 15), 16, 10).cast("bigint")
    # the tables of strata are broadcast: a join on the stratum would send the greatest one, most of the rows, to one task
    own = row_index(keyed.join(F.broadcast(sizes.drop("_n")), "_key").withColumn("_h", first), "estrato", "_h", few=True)
    out = own.join(F.broadcast(strata), "estrato").withColumn("_r", F.col("_idx") + 1)
    split = F.when(F.col("_r") <= F.col("_quota"), F.lit("test")).otherwise(F.lit("train"))
    return out.withColumn("split", split).select(*df.columns, "estrato", "split")


# ------------------------------------------------------------------------------------------------ W7 greedy
DIVERSE_SCHEMA = T.StructType([
    T.StructField("dim", T.StringType()), T.StructField("turn", T.IntegerType()),
    T.StructField("decada", T.IntegerType()), T.StructField("artist", T.StringType()),
    T.StructField("verso_texto", T.StringType()), T.StructField("similitud_coseno", T.DoubleType()),
])


def _picked_in_turns(cands: pd.DataFrame, target: int, lo: float, hi: float, keep: str) -> pd.DataFrame:
    """The pick of one dimension. Candidates inside the band, one per verse (its first or its best occurrence), queue
    up by decade, best first. A heap of (lap, decade) says whose turn it is; a decade gives its best candidate by an
    artist nobody has given yet and enters the next lap, or leaves when it has none."""
    best_first = {"by": ["similitud_coseno", "attractor", "rank"], "ascending": [False, True, True], "kind": "stable"}
    first_seen = {"by": ["attractor", "rank"], "kind": "stable"}
    inside = cands[cands["similitud_coseno"].between(lo, hi)].sort_values(**(best_first if keep == "best" else first_seen))
    ranked = inside.drop_duplicates("verso_texto").sort_values(**best_first)
    queues = {int(decade): iter(own.to_dict("records")) for decade, own in ranked.groupby("decada")}
    turns = [(0, decade) for decade in queues]
    heapify(turns)
    artists: set = set()
    picked: list[dict] = []
    while turns and len(picked) < target:
        lap, decade = heappop(turns)
        choice = next((c for c in queues[decade] if c["artist"] not in artists), None)
        if choice is not None:
            artists.add(choice["artist"])
            picked.append({**choice, "turn": len(picked)})
            heappush(turns, (lap + 1, decade))
    return pd.DataFrame(picked, columns=[f.name for f in DIVERSE_SCHEMA.fields])


def diverse_round_robin(cands: DataFrame, target: int = DIVERSE_TARGET, lo: float = 0.60, hi: float = 0.90,
                        keep: str = "best") -> DataFrame:
    """Candidates (dim, attractor, rank, decada, artist, verso_texto, similitud_coseno). The greedy is
    sequential, but its input per dimension is bounded by attractors x k (J7), so one ``applyInPandas`` group
    per dimension is safe at any corpus size. ``keep='first'`` reproduces the study's first-occurrence rule."""
    cols = ["dim", "attractor", "rank", "decada", "artist", "verso_texto", "similitud_coseno"]
    return cands.select(*cols).groupBy("dim").applyInPandas(
        lambda pdf: _picked_in_turns(pdf, target, lo, hi, keep), DIVERSE_SCHEMA)


__all__ = ["dedupe", "neighbour_context", "neighbour_context_inline", "quota_sample", "sample_units", "sample_n",
           "review_sheet", "ordered_distinct_units", "stratified_split", "diverse_round_robin", "hash_key",
           "py_strip"]
