"""Lexicon matching.

A lexicon given as a Python dictionary is compiled into the plan as ``IN`` lists (Catalyst turns lists of more than 10
terms into hash-set lookups): scoring is a per-row projection with no join and no shuffle, whatever its number of
terms. A lexicon given as a (dim, term) table is joined; which of the two is used is the caller's choice, and both
give the same scores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantoria.fixed import DIMS, KWIC_WINDOW, MIN_STRONG_TERMS, lexicon_pairs
from cantoria.functions.text import tokens, word_runs


def lexicon_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """(dim, term), distinct."""
    return spark.createDataFrame(lexicon_pairs(lexicon), "dim string, term string")


def _terms(lexicon: dict[str, list[str]], dim: str) -> list[str]:
    return sorted(set(lexicon.get(dim, [])))


def dim_hits(tok: Column, terms: list[str]) -> Column:
    """Number of token occurrences that are lexicon terms."""
    if not terms:
        return F.lit(0)
    return F.size(F.filter(tok, lambda t: t.isin(terms)))


def score_units(units: DataFrame, lexicon: dict[str, list[str]], text_col: str = "verso_texto", cap: int = 3,
                mode: str = "runs") -> DataFrame:
    """E8 on a unit table: adds ``intensidad_<dim>`` = min(cap, lexicon hits of that dimension), in a projection."""
    # tokens bound once as a column, then counted per dimension
    tok = F.col("_tok")
    return (units.withColumn("_tok", tokens(text_col, mode))
            .select(*units.columns, *[F.least(dim_hits(tok, _terms(lexicon, d)), F.lit(cap)).alias(f"intensidad_{d}")
                                      for d in DIMS]))


BROADCAST_TERMS = 100_000


def score_units_by_table(units: DataFrame, lexicon: DataFrame, id_cols: list[str], text_col: str = "verso_texto", cap: int = 3,
                         mode: str = "runs") -> DataFrame:
    """E8 with a lexicon table (dim, term) of any size; ``id_cols`` identify a unit. A lexicon of at most
    ``BROADCAST_TERMS`` rows goes to the tokens, so only hits are shuffled; for a larger one tokens are counted per unit
    before they meet it, and the join is left to the planner."""
    words = units.select(*id_cols, F.explode(tokens(text_col, mode)).alias("term"))
    terms = lexicon.select("dim", "term").distinct()
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        found = words.join(F.broadcast(terms), "term").withColumn("_n", F.lit(1))
    else:
        found = words.groupBy(*id_cols, "term").agg(F.count(F.lit(1)).alias("_n")).join(terms, "term")
    hits = found.groupBy(*id_cols).agg(*[F.sum(F.when(F.col("dim") == d, F.col("_n"))).alias(f"_{d}") for d in DIMS])
    out = units.join(hits, id_cols, "left")
    return out.select(*units.columns, *[F.least(F.coalesce(F.col(f"_{d}"), F.lit(0)), F.lit(cap)).cast("int").alias(f"intensidad_{d}") for d in DIMS])


def score_array(units: Column, lexicon: dict[str, list[str]], text_field: str, cap: int = 3,
                mode: str = "runs") -> Column:
    """E8 inside the document row: array<struct<..., text>> -> same structs plus the six intensities.
    Two passes over the array: the first binds each unit's tokens once, the second counts the hits of each
    dimension against that bound token array (so a unit is tokenised once, not once per dimension)."""
    fields = _struct_fields(units, text_field)
    with_tok = F.transform(units, lambda u: F.struct(*[u[f].alias(f) for f in fields],
                                                     tokens(u[text_field], mode).alias("_tok")))

    def one(u):
        return F.struct(*[u[f].alias(f) for f in fields],
                        *[F.least(dim_hits(u["_tok"], _terms(lexicon, d)), F.lit(cap)).alias(f"intensidad_{d}")
                          for d in DIMS])
    return F.transform(with_tok, one)


def _struct_fields(units: Column, text_field: str) -> list[str]:
    # The unit builders in units.py produce (verso_idx, verso_texto) or (estrofa_no, texto_entrenamiento).
    return ["verso_idx", "verso_texto"] if text_field == "verso_texto" else ["estrofa_no", "texto_entrenamiento"]


def lexical_mark(songs: DataFrame, terms: list[str], threshold: int = MIN_STRONG_TERMS, text_col: str = "lyrics",
                 mode: str = "code") -> DataFrame:
    """``conteo_narco`` = number of distinct strong terms in the text; ``es_narco_fuerte`` when >= threshold."""
    tset = sorted(set(terms))
    distinct_tokens = F.array_distinct(tokens(text_col, mode))
    count = F.size(F.filter(distinct_tokens, lambda t: t.isin(tset)))
    return songs.withColumn("conteo_narco", count).withColumn("es_narco_fuerte", F.col("conteo_narco") >= threshold)


def vocabulary_intersect(text_col: str, terms: list[str], mode: str = "code") -> Column:
    """Distinct tokens of the text that are lexicon terms, sorted."""
    tset = sorted(set(terms))
    return F.array_sort(F.filter(F.array_distinct(tokens(text_col, mode)), lambda t: t.isin(tset)))


def dimension_regex(terms: list[str]) -> str:
    """F2 pattern: case-insensitive (Unicode) whole-word alternation of the escaped terms."""
    return r"(?iu)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"


def match_dim(df: DataFrame, terms: list[str], text_col: str = "verso_texto") -> DataFrame:
    """rows whose text contains any of the terms as a whole word; null text -> no match."""
    if not terms:
        return df.limit(0)
    return df.where(F.coalesce(F.col(text_col).rlike(dimension_regex(terms)), F.lit(False)))


def keyword_in_context(songs: DataFrame, terms: list[str], window: int = KWIC_WINDOW, text_col: str = "lyrics",
                       mode: str = "code", artist_col: str = "artist", song_col: str = "song") -> DataFrame:
    """One row per token occurrence that is a strong term: ±window tokens (clipped at the ends) wrapped as
    '... x ...'. Output columns Artista, Cancion, Palabra, Contexto, plus song_id and token position."""
    tset = sorted(set(terms))
    base = songs.select("song_id", F.col(artist_col).alias("Artista"), F.col(song_col).alias("Cancion"),
                        tokens(text_col, mode).alias("_tok"))
    occ = base.select("*", F.posexplode("_tok").alias("pos", "Palabra")).where(F.col("Palabra").isin(tset))
    start = F.greatest(F.col("pos") - window, F.lit(0))
    ctx = F.slice("_tok", start + 1, F.col("pos") + window + 1 - start)
    return occ.select("song_id", "pos", "Artista", "Cancion", "Palabra",
                      F.concat(F.lit("... "), F.array_join(ctx, " "), F.lit(" ...")).alias("Contexto"))


__all__ = ["lexicon_table", "score_units", "score_array", "lexical_mark", "match_dim", "keyword_in_context",
           "vocabulary_intersect", "dimension_regex", "word_runs"]
