"""Joins between units, reviews, rollups and the corpus.

Joins to the corpus dedupe the corpus side first by default (one row per key, first in source order), so a
repeated (artist, song) never fans rows out. ``null_safe=True`` reproduces pandas' merge, which matches null keys
to each other; the default is SQL semantics (null keys never match).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.functions.text import py_strip
from cantoria.operators.select import dedupe


def _key(cols: list[str]):
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols]) if len(cols) > 1 else F.col(cols[0])


def minus(pool: DataFrame, seen: DataFrame, text_col: str = "verso_texto", strip: bool = True) -> DataFrame:
    """Pool rows whose (stripped) text is not among the seen texts (anti join)."""
    norm = py_strip if strip else F.col
    s = seen.select(norm(text_col).alias("_seen")).distinct()
    return pool.withColumn("_seen", norm(text_col)).join(s, "_seen", "left_anti").drop("_seen")


def attach(df: DataFrame, corpus: DataFrame, keys: tuple[str, ...] = ("artist", "song"), how: str = "left",
           cols: tuple[str, ...] = ("lyrics",), dedupe_corpus: bool = True, order: str = "song_id",
           null_safe: bool = False) -> DataFrame:
    """J2 (``how='left'``) / J3 (``how='inner'``): attach corpus columns on the keys."""
    keys = list(keys)
    side = corpus.select(*keys, order, *cols)
    if dedupe_corpus:
        side = dedupe(side, _key(keys), [order])
    side = side.drop(order)
    if not null_safe:
        return df.join(side, keys, how)
    r = side.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *cols)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def lookup_last(df: DataFrame, corpus: DataFrame, key: str = "song", col: str = "lyrics", order: str = "song_id",
                out: str = "_l") -> DataFrame:
    """Key -> value dictionary where the last row wins (largest ``order``), left-joined; absent -> null."""
    d = dedupe(corpus.select(key, order, F.col(col).alias(out)), key, [order], last=True).drop(order)
    return df.join(d, key, "left")


def truth(verdicts: DataFrame, rollup: DataFrame, keys: tuple[str, ...] = ("artist", "song"),
          score: str = "densidad_semantica_v2") -> DataFrame:
    """Inner join of the song-level verdict with the song score (only the needed columns); rows without a
    score are dropped (a metric over them is undefined)."""
    keys = list(keys)
    return (verdicts.join(rollup.select(*keys, score), keys, "inner").where(F.col(score).isNotNull()))
