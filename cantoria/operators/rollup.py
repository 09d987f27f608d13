"""Unit -> document rollups, thresholds and audit counts.

Two rollup forms:

* **in-row** (``*_inline``): the units of a document are an array column of the document row, so the
  per-document rollup is a projection (``aggregate``/``array_max`` over the array) — no explode, no shuffle.
  Used when units come from the document itself (the normal case: E1/E2/E3 output).
* **grouped**: a ``groupBy`` over a unit table, for units that arrive separately (reviews, model output).
  Spark's partial aggregation combines map-side, so only one row per key and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.fixed import DENSITY_FILTER, DENSITY_USEFUL, DIMS, INTENSITY_COLS, LABEL_COLS
from cantoria.functions.scores import density_category, density_zone, is_active
from cantoria.functions.text import PY_WS, bucket, normalize_text, year_num
from cantoria.operators.lexicon import score_array
from cantoria.operators.units import dense_verse_array, stanza_array, verse_array

# FIXED VALUES: category labels of the pass/noise split
PASS_LABEL = "Pasan el Filtro (>0%)"
NOISE_LABEL = "Ruido (0%)"


# ------------------------------------------------------------------------------------------ in-row unit rollups
def _dim_values(units: Column, col: str) -> Column:
    return F.transform(units, lambda u: u[col])


def _sum_int(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _active_count(units: Column) -> Column:
    return F.size(F.filter(units, lambda u: F.greatest(*[u[c] for c in INTENSITY_COLS]) > 0)).cast("bigint")


def with_scored_units(songs: DataFrame, lexicon: dict[str, list[str]], unit: str = "stanza",
                      normalize: bool = True) -> DataFrame:
    """Adds ``_units``: the document's units with their six E8 intensities (stanza: E3 after P1; verse: E1;
    dense: E2)."""
    if unit == "stanza":
        text = normalize_text("lyrics") if normalize else F.col("lyrics")
        arr = F.transform(stanza_array(text), lambda s, i: F.struct(i.alias("estrofa_no"),
                                                                     s.alias("texto_entrenamiento")))
        field = "texto_entrenamiento"
    elif unit == "verse":
        arr, field = verse_array("lyrics"), "verso_texto"
    elif unit == "dense":
        arr, field = dense_verse_array("lyrics"), "verso_texto"
    else:
        raise ValueError(unit)
    return songs.withColumn("_units", score_array(arr, lexicon, field))


def rollup_columns(units: Column | None = None, total_name: str = "total_estrofas",
                   active_name: str = "estrofas_activas", density_name: str = "densidad_semantica_v2",
                   with_avg: bool = True) -> list[Column]:
    """A7 in-row: count, active count, per-dimension max and mean, density = active / count.
    All null for a document without units."""
    units = F.col("_units") if units is None else units
    n = F.size(units)
    has = n > 0
    cols = [F.when(has, n.cast("bigint")).alias(total_name), F.when(has, _active_count(units)).alias(active_name)]
    cols += [F.when(has, F.array_max(_dim_values(units, c))).alias(f"{c}_max") for c in INTENSITY_COLS]
    if with_avg:
        cols += [F.when(has, _sum_int(_dim_values(units, c)) / n).alias(f"{c}_avg") for c in INTENSITY_COLS]
    cols.append(F.when(has, _active_count(units) / n).alias(density_name))
    return cols


def stanza_rollup_inline(songs: DataFrame, lexicon: dict[str, list[str]], normalize: bool = True) -> DataFrame:
    """One row per song that has stanzas (song_id + rollup), without any shuffle."""
    # A song has a stanza iff its text has a non-whitespace character: filtering on that (cheap) predicate
    # first keeps the optimizer from re-evaluating the scored units inside a pushed-down filter.
    has_text = F.col("lyrics").rlike("[^" + PY_WS[1:-1] + "]")
    scored = with_scored_units(songs.where(has_text), lexicon, "stanza", normalize)
    return scored.select("song_id", *rollup_columns())


def rollup_back_to_songs(songs: DataFrame, lexicon: dict[str, list[str]], normalize: bool = True) -> DataFrame:
    """J4 fused with A7: every song (lyrics dropped) with its rollup; songs without stanzas keep nulls. Because
    the units come from the song row, the 'left join' is a projection."""
    scored = with_scored_units(songs, lexicon, "stanza", normalize)
    keep = [c for c in songs.columns if c not in ("lyrics",)]
    return scored.select(*keep, *rollup_columns())


def join_rollup(songs: DataFrame, rollup: DataFrame, key: str = "song_id") -> DataFrame:
    """J4 for a rollup computed elsewhere: songs left join rollup."""
    return songs.drop("lyrics").join(rollup, key, "left")


# ---------------------------------------------------------------------------------------------- grouped rollups
def _first_nonnull(col: str, order: Column) -> Column:
    """pandas ``first``: the first non-null value in source order."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), order))


def _keys_not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.where(cond)


def song_density(units: DataFrame, keys: tuple[str, ...] = ("artist", "song"), text_col: str = "verso_texto",
                 order: tuple[str, ...] = ("song_id", "verso_idx")) -> DataFrame:
    """A6 over a scored unit table: per key, first year, unit count, active count, per-dimension max,
    density = active / count. Null keys are dropped (pandas groupby)."""
    keys = list(keys)
    ordc = F.struct(*[F.col(c) for c in order])
    u = _keys_not_null(units, keys).withColumn("_active", is_active())
    return (u.groupBy(*keys).agg(
        _first_nonnull("year", ordc).alias("year"),
        F.count(text_col).alias("total_versos"),
        F.sum("_active").cast("bigint").alias("versos_activos"),
        *[F.max(c).alias(c) for c in INTENSITY_COLS])
        .withColumn("densidad_agenciamiento", F.col("versos_activos") / F.col("total_versos")))


def song_density_inline(songs: DataFrame, lexicon: dict[str, list[str]], unit: str = "verse",
                        keys: tuple[str, ...] = ("artist", "song")) -> DataFrame:
    """A6 with in-row pre-aggregation: each song row is reduced to (count, active, maxes) first, then only one
    row per song is shuffled to combine songs sharing a key. Songs without units drop out in the aggregate
    (their count is 0 and they never provide the first year), not in a filter over the scored array."""
    keys = list(keys)
    scored = with_scored_units(_keys_not_null(songs, keys), lexicon, unit)
    u = F.col("_units")
    per_song = scored.select(
        *keys, "song_id", "year", F.size(u).cast("bigint").alias("_n"), _active_count(u).alias("_a"),
        *[F.array_max(_dim_values(u, c)).alias(c) for c in INTENSITY_COLS])
    agg = per_song.groupBy(*keys).agg(
        F.min_by(F.col("year"), F.when((F.col("_n") > 0) & F.col("year").isNotNull(), F.col("song_id"))).alias("year"),
        F.sum("_n").alias("total_versos"),
        F.sum("_a").alias("versos_activos"),
        *[F.max(c).alias(c) for c in INTENSITY_COLS])
    return (agg.where(F.col("total_versos") > 0)
            .withColumn("densidad_agenciamiento", F.col("versos_activos") / F.col("total_versos")))


def song_condense(units: DataFrame, keys: tuple[str, ...] = ("artist", "song"), text_col: str = "verso_texto",
                  order: tuple[str, ...] = ("song_id", "verso_idx"), prefix: str = "intensidad_") -> DataFrame:
    """A5: per key: first year, non-null unit count, max per dimension (sort by year at the sink)."""
    keys = list(keys)
    ordc = F.struct(*[F.col(c) for c in order])
    return (_keys_not_null(units, keys).groupBy(*keys).agg(
        _first_nonnull("year", ordc).alias("year"),
        F.count(text_col).alias("total_versos"),
        *[F.max(f"{prefix}{d}").alias(f"{prefix}{d}") for d in DIMS]))


def label_max_pool(reviews: DataFrame, text_col: str = "verso_texto", order: tuple[str, ...] = ("song_id", "verso_idx"),
                   extra_first: tuple[str, ...] = ("year", "artist")) -> DataFrame:
    """A3: one row per unit text: max of each label, first non-null of the extra columns in source order."""
    ordc = F.struct(*[F.col(c) for c in order])
    return (reviews.where(F.col(text_col).isNotNull()).groupBy(text_col).agg(
        *[F.max(c).alias(c) for c in LABEL_COLS],
        *[_first_nonnull(c, ordc).alias(c) for c in extra_first]))


def label_merge_by_file_dim(reviews: DataFrame, keys: tuple[str, ...] = ("artist", "song", "verso_texto"),
                            dim_col: str = "dim", value_col: str = "valor") -> DataFrame:
    """A4: each review file carries one dimension; per key the max per dimension, absent dimension -> 0,
    null keys dropped."""
    keys = list(keys)
    piv = _keys_not_null(reviews, keys).groupBy(*keys).pivot(dim_col, DIMS).agg(F.max(value_col))
    return piv.select(*keys, *[F.coalesce(F.col(d), F.lit(0)).cast("int").alias(f"intensidad_{d}") for d in DIMS])


def song_truth(reviews: DataFrame, keys: tuple[str, ...] = ("artist", "song"), label: str = "es_util_real") -> DataFrame:
    """A song is useful if any of its reviewed units is."""
    return (_keys_not_null(reviews.where(F.col(label).isNotNull()), list(keys))
            .groupBy(*keys).agg(F.max(label).cast("int").alias(label)))


def yearly_means(rollup: DataFrame, years: tuple[int, int] = (1970, 2025),
                 cols: list[str] | None = None) -> DataFrame:
    """Mean density and the six mean intensities per (numeric) year inside the range."""
    cols = cols or ["densidad_semantica_v2"] + [f"{c}_avg" for c in INTENSITY_COLS]
    y = year_num("year")
    return (rollup.withColumn("year_n", y).where(F.col("year_n").between(*years))
            .groupBy(F.col("year_n").cast("int").alias("year"))
            .agg(*[F.avg(c).alias(c) for c in cols]))


def year_category_pivot(rollup: DataFrame, years: tuple[int, int] = (1970, 2025),
                        density: str = "densidad_semantica_v2") -> DataFrame:
    """A10 (+P18): songs per year x pass/noise, both columns always present, 0-filled."""
    y = year_num("year")
    df = (rollup.withColumn("year_n", y).where(F.col("year_n").between(*years))
          .withColumn("categoria", density_category(density, PASS_LABEL, NOISE_LABEL)))
    piv = df.groupBy(F.col("year_n").cast("int").alias("year")).pivot("categoria", [PASS_LABEL, NOISE_LABEL]).count()
    return piv.select("year", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (PASS_LABEL, NOISE_LABEL)])


def density_threshold(df: DataFrame, t: float = DENSITY_FILTER, col: str = "densidad_agenciamiento") -> DataFrame:
    """F4."""
    return df.where(F.col(col) >= t)


def density_zones(df: DataFrame, useful: float = DENSITY_USEFUL, col: str = "densidad_agenciamiento") -> DataFrame:
    """one pass, one ``zona`` column (util / gris / descarte)."""
    return df.withColumn("zona", density_zone(col, useful))


def reviewed_only(df: DataFrame, label: str = "es_util_real") -> DataFrame:
    """F7."""
    return df.dropna(subset=[label])


def label_histogram(gold: DataFrame, cols: list[str] = INTENSITY_COLS) -> DataFrame:
    """Per dimension and label value: count, dimension total, active (>0) count and %."""
    stack = F.expr("stack({n}, {pairs}) as (dim, label)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols)))
    long = gold.select(stack).where(F.col("label").isNotNull())
    per = long.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    tot = long.groupBy("dim").agg(F.count(F.lit(1)).alias("total"),
                                  F.count_if(F.col("label") > 0).alias("activos"))
    return (per.join(tot, "dim")
            .withColumn("pct_activos", F.col("activos") * 100.0 / F.col("total")))


def decade_counts(df: DataFrame, by: str = "origen", year_col: str = "year") -> DataFrame:
    """Rows per origin x decade; rows without a numeric year fall out."""
    d = bucket(year_num(year_col), 10)
    return df.where(d.isNotNull()).groupBy(by, d.alias("decada")).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """A13 (and any frequency top-n): count per value, highest first, ties by value. A top-n report: the limit
    is the feature; Spark plans it as TakeOrderedAndProject (per-task top-n, then merge)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(n))


def density_histogram(df: DataFrame, col: str = "densidad_semantica_v2", bins: int = 40) -> DataFrame:
    """Equal bins over [0, 1] of densities > 0; the top edge joins the last bin."""
    b = F.least(F.expr(f"width_bucket(`{col}`, 0D, 1D, {bins})"), F.lit(bins))
    return (df.where(F.col(col) > 0).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("lo", (F.col("bin") - 1) / F.lit(float(bins)))
            .withColumn("hi", F.col("bin") / F.lit(float(bins))))


def filter_audit(df: DataFrame, col: str = "densidad_agenciamiento", useful: float = DENSITY_USEFUL) -> DataFrame:
    """One row of counters: total, passed (>0), noise (=0 or null), per-zone counts."""
    c = F.col(col)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c > 0).alias("pasan"),
        F.count_if(F.coalesce(c, F.lit(0.0)) <= 0).alias("ruido"),
        F.count_if(c >= useful).alias("util"),
        F.count_if((c > 0) & (c < useful)).alias("gris"),
        F.count_if(c == 0).alias("descarte"))


def flow_stats(regex_in: DataFrame, kmeans_in: DataFrame, deduped: DataFrame, balanced: DataFrame) -> DataFrame:
    """The one-row flow counters; synthetic = after balancing - deduplicated. One pass over a tagged union
    of the four inputs (no join)."""
    names = ["regex_in", "kmeans_in", "deduplicado", "smote_out"]
    tagged = None
    for df, name in zip([regex_in, kmeans_in, deduped, balanced], names):
        t = df.select(F.lit(name).alias("_t"))
        tagged = t if tagged is None else tagged.unionByName(t)
    s = tagged.agg(*[F.count_if(F.col("_t") == n).alias(n) for n in names])
    return s.withColumn("sinteticos_creados", F.col("smote_out") - F.col("deduplicado"))


def flow_edges(stats: DataFrame) -> DataFrame:
    """A19 edges (source, target, value) of the flow diagram."""
    e = F.expr("stack(5, 'Regex', 'Consolidado', regex_in, 'K-Means', 'Consolidado', kmeans_in, "
               "'Consolidado', 'Deduplicado', deduplicado, 'Deduplicado', 'Balanceado', deduplicado, "
               "'Sintéticos', 'Balanceado', sinteticos_creados) as (source, target, value)")
    return stats.select(e)
