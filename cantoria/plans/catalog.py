"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the driver's tables.

The corpus is the driver's ``documents`` table read as ``songs`` (sources.tables.songs_from_documents); lexicon
scoring uses the stand-in lexicon (fixed.STANDIN_LEXICON) because the study's own terms never occur in it.
Doubles are rounded to 6 places at the output so sums taken in a different order compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from cantoria.fixed import (DENSITY_SERIES, DIMS, INTENSITY_COLS, LABEL_COLS, STANDIN_LEXICON,
                            STANDIN_STRONG_TERMS)
from cantoria.functions.scores import is_active
from cantoria.functions.text import bucket, fingerprint, year_num
from cantoria.operators import containment as ct
from cantoria.operators import layout as ly
from cantoria.operators import lexicon as lx
from cantoria.operators import rollup as ru
from cantoria.operators import units as un
from cantoria.sources.tables import read_songs
from cantoria.sources.tables import songs as load_songs
from cantoria.sources.tables import table
from cantoria.session import cut_lineage, written

LEX = STANDIN_LEXICON
QUERIES: dict = {}
_STAGES: dict = {}


def stage(key: tuple, build, keep=cut_lineage) -> DataFrame:
    """A derived stage table (small: review-sized or one row per song) checkpointed, or with text ``written``, once per query
    invocation and shared by every branch of that query. ``reset_stages`` runs before each registered query."""
    if key not in _STAGES:
        _STAGES[key] = keep(build())
    return _STAGES[key]


def reset_stages() -> None:
    _STAGES.clear()


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (output convention shared with the oracle)."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scored_verses(spark, sf) -> DataFrame:
    return lx.score_units(un.to_verses(load_songs(spark, sf)), LEX)


def song_rollup(spark, sf) -> DataFrame:
    """J4 + A7: every song with its stanza rollup (nulls when it has no stanza).

    The rollup is a stage table (one small row per song, no text): it is checkpointed into the shared folder,
    so the statistics built on it read it once instead of re-deriving stanzas in every plan branch."""
    return stage(("song_rollup", sf), lambda: ru.rollup_back_to_songs(load_songs(spark, sf), LEX))


# ---------------------------------------------------------------------------------------------------- sources
@register("scan_songs")
def scan_songs(spark: SparkSession, sf: str) -> DataFrame:
    return load_songs(spark, sf).select("song_id", "artist", "album", "year", "song", "lyrics")


# ------------------------------------------------------------------------------------------------------ units
@register("verse_explode")
def verse_explode(spark, sf):
    return un.to_verses(load_songs(spark, sf))


@register("verse_explode_dense")
def verse_explode_dense(spark, sf):
    return un.to_verses(load_songs(spark, sf), min_len=5, reindex=True)


@register("stanza_explode")
def stanza_explode(spark, sf):
    return un.to_stanzas(load_songs(spark, sf))


@register("lexicon_hits")
def lexicon_hits(spark, sf):
    return scored_verses(spark, sf)


# ---------------------------------------------------------------------------------------------------- rollups
@register("lexicon_hits_by_table")
def lexicon_hits_by_table(spark, sf):
    """E8 with the lexicon as a table: the same scores as the projection."""
    v = un.to_verses(load_songs(spark, sf))
    return lx.score_units_by_table(v, lx.lexicon_table(spark, LEX), ["song_id", "verso_idx"])


@register("song_density")
def song_density(spark, sf):
    return r6(ru.song_density_inline(load_songs(spark, sf), LEX, unit="verse"))


@register("density_zones")
def density_zones(spark, sf):
    """Flagship: documents -> verses -> lexicon scores -> song density -> zones -> songs per decade x zone."""
    dens = ru.density_zones(ru.song_density_inline(load_songs(spark, sf), LEX, unit="verse"))
    return (dens.groupBy(bucket(year_num("year"), 10).alias("decada"), "zona")
            .agg(F.count(F.lit(1)).alias("canciones")))


@register("density_threshold")
def density_threshold(spark, sf):
    return r6(ru.density_threshold(ru.song_density_inline(load_songs(spark, sf), LEX, unit="verse")))


@register("stanza_rollup")
def stanza_rollup(spark, sf):
    return r6(ru.stanza_rollup_inline(load_songs(spark, sf), LEX))


@register("rollup_back_to_songs")
def rollup_back_to_songs(spark, sf):
    return r6(song_rollup(spark, sf))


@register("filter_audit")
def filter_audit(spark, sf):
    return ru.filter_audit(ru.song_density_inline(load_songs(spark, sf), LEX, unit="verse"))


@register("yearly_means")
def yearly_means(spark, sf):
    return r6(ru.yearly_means(song_rollup(spark, sf)))


@register("year_category_pivot")
def year_category_pivot(spark, sf):
    return ru.year_category_pivot(song_rollup(spark, sf))


@register("density_histogram")
def density_histogram(spark, sf):
    return r6(ru.density_histogram(song_rollup(spark, sf)))


@register("song_fingerprint")
def song_fingerprint(spark, sf):
    return load_songs(spark, sf).select("song_id", fingerprint("artist", "song").alias("huella"))


# ------------------------------------------------------------------------------------------ text projections
from cantoria.fixed import LANG_STOPWORDS, STOPWORDS_ES  # noqa: E402
from cantoria.functions import scores as sc  # noqa: E402
from cantoria.functions import text as tx  # noqa: E402
from cantoria.operators import joins as jn  # noqa: E402
from cantoria.operators import language as lang  # noqa: E402
from cantoria.operators import select as sel  # noqa: E402
from cantoria.sources.reviews import review_rows, reviews_union  # noqa: E402


def reviews(spark, sf) -> DataFrame:
    """S2 review union as a stage table (review-sized)."""
    return stage(("reviews", sf), lambda: reviews_union(spark, sf), written)


@register("collapse_ws")
def collapse_ws_q(spark, sf):
    return un.to_verses(load_songs(spark, sf)).select("song_id", "verso_idx",
                                                      tx.collapse_ws("verso_texto").alias("texto_norm"))


@register("parse_release_title")
def parse_release_title(spark, sf):
    s = load_songs(spark, sf)
    title = (F.when(F.col("song_id") % 3 == 0, F.col("artist"))
             .when(F.col("song_id") % 3 == 1, F.concat(F.col("artist"), F.lit("* (2) - "), F.col("album")))
             .otherwise(F.concat(F.col("artist"), F.lit(" -  "), F.col("album"), F.lit("  - Remix - "), F.col("song"))))
    artist, album = tx.parse_release_title(title)
    return s.select("song_id", artist.alias("artista"), album.alias("album"))


@register("min_length_filter")
def min_length_filter(spark, sf):
    s = load_songs(spark, sf)
    return s.where(F.length("lyrics") >= 150).select("song_id", F.length("lyrics").alias("n_chars"))


def detect_language(text_col: str = "lyrics", langs: dict = LANG_STOPWORDS):
    """P6 (re-aimed): stop-word hit count per language, argmax (ties: first language), none -> null."""
    tok = tx.word_runs(text_col)
    def hits(words):
        wl = sorted(set(words))
        return F.size(F.filter(tok, lambda t: t.isin(wl)))
    counts = {l: hits(w) for l, w in langs.items()}
    mx = F.greatest(*counts.values())
    expr = F.when(mx == 0, F.lit(None).cast("string"))
    for l, c in counts.items():
        expr = expr.when(c == mx, F.lit(l))
    return expr


@register("language_filter")
def language_filter(spark, sf):
    s = load_songs(spark, sf).select("song_id", "lang", detect_language().alias("lang_detectado"))
    return s.where(F.col("lang_detectado") == "es")


@register("language_profiles")
def language_profiles(spark, sf):
    """P6 trained: the language of every document by profiles learnt on four fifths of them; the rest is held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model, least = lang.learn(docs.where(~held), "doc_id", "text", "lang")
    found = lang.detect(docs, model, least, "doc_id", "text")
    return r6(found.join(docs.select("doc_id", "lang", held.alias("apartado")), "doc_id"))


@register("tokenize")
def tokenize(spark, sf):
    t = tx.tokens("lyrics", "word")
    return load_songs(spark, sf).select("song_id", F.size(t).alias("n_tokens"),
                                        F.array_join(t, " ").alias("tokens_txt"))


@register("tokenize_alnum_hyphen")
def tokenize_alnum_hyphen(spark, sf):
    t = tx.tokens("lyrics", "code")
    return load_songs(spark, sf).select("song_id", F.size(t).alias("n_tokens"),
                                        F.array_join(t, " ").alias("tokens_txt"))


@register("remove_stopwords")
def remove_stopwords(spark, sf):
    return load_songs(spark, sf).select("song_id", tx.remove_stopwords("lyrics", STOPWORDS_ES).alias("lyrics_limpias"))


@register("coerce_year")
def coerce_year(spark, sf):
    y = tx.year_num("year")
    return load_songs(spark, sf).select("song_id", y.alias("year_num"), tx.bucket(y, 10).alias("decada"),
                                        tx.bucket(y, 5).alias("lustro"))


@register("year_range_filter")
def year_range_filter(spark, sf):
    y = tx.year_num("year")
    return (load_songs(spark, sf).where(y.between(1970, 2025))
            .select("song_id", y.cast("int").alias("year_n")))


@register("coerce_labels")
def coerce_labels(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", tx.label_int(F.col("quality").cast("string")).alias("es_util_real"),
                      tx.label_int(F.col("toxic").cast("string")).alias("toxico"))


def gold(spark, sf) -> DataFrame:
    """A3 over the derived review union: one row per verse text (a review-sized stage table, checkpointed)."""
    return stage(("gold", sf), lambda: ru.label_max_pool(reviews(spark, sf)), written)


@register("dominant_dimension")
def dominant_dimension(spark, sf):
    dom, mx = sc.dominant_dimension("val_")
    return (gold(spark, sf).select("verso_texto", dom.alias("dimension_dominante"), mx.alias("intensidad_max"))
            .where(F.col("intensidad_max") > 0))


@register("round_clip_labels")
def round_clip_labels(spark, sf):
    r = song_rollup(spark, sf).where(F.col("total_estrofas").isNotNull())
    return r.select("song_id", *[sc.ordinal(F.col(f"{c}_avg") * 3).alias(f"val_{d}")
                                 for c, d in zip(INTENSITY_COLS, DIMS)])


def density_percent(df: DataFrame, col: str = "densidad_semantica_v2") -> DataFrame:
    """Percent when the column's maximum is <= 1 (one scalar aggregate, read back as a literal),
    half-even rounded to int."""
    mx = df.agg(F.max(col)).first()[0]
    scale = 100.0 if mx is not None and mx <= 1 else 1.0
    return df.withColumn("densidad_porcentual", F.bround(F.col(col) * scale, 0).cast("int"))


@register("density_percent")
def density_percent_q(spark, sf):
    return density_percent(song_rollup(spark, sf)).select("song_id", "densidad_porcentual")


@register("density_category")
def density_category(spark, sf):
    return song_rollup(spark, sf).select(
        "song_id", sc.density_category("densidad_semantica_v2", ru.PASS_LABEL, ru.NOISE_LABEL).alias("categoria"))


# ------------------------------------------------------------------------------------- marking, kwic, filters
def deduped_songs(spark, sf) -> DataFrame:
    """W5 on the song fingerprint, first song_id wins."""
    return sel.dedupe(load_songs(spark, sf), fingerprint("artist", "song"), ["song_id"])


def marked(spark, sf) -> DataFrame:
    return lx.lexical_mark(deduped_songs(spark, sf), STANDIN_STRONG_TERMS, mode="code")


@register("keep_first_dedupe")
def keep_first_dedupe(spark, sf):
    return deduped_songs(spark, sf).select("song_id", "artist", "song")


@register("lexical_mark")
def lexical_mark(spark, sf):
    return lx.lexical_mark(load_songs(spark, sf), STANDIN_STRONG_TERMS, mode="code").select(
        "song_id", "conteo_narco", "es_narco_fuerte")


@register("keyword_in_context")
def keyword_in_context(spark, sf):
    flagged = marked(spark, sf).where("es_narco_fuerte")
    return lx.keyword_in_context(flagged, STANDIN_STRONG_TERMS, mode="code")


@register("rank_by_decade_hits")
def rank_by_decade_hits(spark, sf):
    m = marked(spark, sf).withColumn("decada", tx.bucket(tx.year_num("year"), 10))
    return (m.where(F.col("decada") > 0).select("song_id", "decada", "conteo_narco")
            .orderBy(F.asc("decada"), F.desc("conteo_narco"), F.asc("song_id")))


@register("dimension_regex_filter")
def dimension_regex_filter(spark, sf):
    v = un.to_verses(load_songs(spark, sf))
    hits = F.array(*[F.when(F.coalesce(F.col("verso_texto").rlike(lx.dimension_regex(LEX[d])), F.lit(False)),
                            F.lit(d)) for d in DIMS])
    return v.select("song_id", "verso_idx", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("dim"))


@register("vocabulary_intersect")
def vocabulary_intersect(spark, sf):
    return load_songs(spark, sf).select(
        "song_id", F.array_join(lx.vocabulary_intersect("lyrics", STANDIN_STRONG_TERMS, mode="code"), ",")
        .alias("terminos"))


@register("word_frequency_topn")
def word_frequency_topn(spark, sf):
    stop = sorted(set(STOPWORDS_ES))
    toks = load_songs(spark, sf).select(F.explode(tx.tokens("lyrics", "word")).alias("term"))
    return ru.top_n(toks.where(~F.col("term").isin(stop)), "term", 100)


def origin_vocab(spark, sf):
    r = review_rows(spark, sf)
    return r.select("origen", F.explode(tx.tokens("verso_texto", "word")).alias("term"))


@register("vocabulary_except")
def vocabulary_except(spark, sf):
    t = origin_vocab(spark, sf)
    b = t.where(F.col("origen") == "K-Means").select("term")
    a = t.where(F.col("origen") == "Regex").select("term")
    return b.distinct().join(a, "term", "left_anti")


@register("exclusive_terms")
def exclusive_terms(spark, sf):
    t = origin_vocab(spark, sf)
    stop = sorted(set(STOPWORDS_ES))
    b = t.where((F.col("origen") == "K-Means") & (F.length("term") > 3) & ~F.col("term").isin(stop)).select("term")
    a = t.where(F.col("origen") == "Regex").select("term")
    return ru.top_n(b.join(a, "term", "left_anti"), "term", 20)


@register("ngrams")
def ngrams(spark, sf):
    stop = sorted({tx_strip for tx_strip in (_strip_py(w) for w in STOPWORDS_ES)})
    tok = F.filter(tx.word_runs(tx.strip_accents(F.lower("lyrics"))), lambda t: ~t.isin(stop))
    # the token array is materialised as a column so the n-gram lambdas index it instead of re-tokenising
    grams = (load_songs(spark, sf).select(tok.alias("_tok"))
             .select(F.explode(un.ngram_array(F.col("_tok"), 1, 2)).alias("ngram")))
    return ru.top_n(grams, "ngram", 100)


def _strip_py(w: str) -> str:
    import unicodedata
    return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")


# --------------------------------------------------------------------------------------------- unit expansion
@register("verse_to_stanza")
def verse_to_stanza(spark, sf):
    s = load_songs(spark, sf)
    return un.verse_to_stanza(un.to_verses(s), s).select("song_id", "verso_idx", "texto_entrenamiento")


@register("verse_to_window")
def verse_to_window(spark, sf):
    s = load_songs(spark, sf)
    return un.verse_to_window(reviews(spark, sf), s).select("song_id", "verso_idx", "texto_entrenamiento")


@register("verse_to_stanza_indexed")
def verse_to_stanza_indexed(spark, sf):
    """E5 by the index of word heads: the rows of ``verse_to_stanza``."""
    s = load_songs(spark, sf)
    return ct.verse_to_stanza_indexed(un.to_verses(s), s).select("song_id", "verso_idx", "texto_entrenamiento")


@register("verse_to_window_indexed")
def verse_to_window_indexed(spark, sf):
    """E6 by the index of word heads: the rows of ``verse_to_window``."""
    return (ct.verse_to_window_indexed(reviews(spark, sf), load_songs(spark, sf))
            .select("song_id", "verso_idx", "texto_entrenamiento"))


# ---------------------------------------------------------------------------------------------------- joins
def pool(spark, sf) -> DataFrame:
    """Verse pool: flagged songs (deduped, decade > 0) -> E1 verses -> first occurrence per verse text in the
    order decade asc, hits desc."""
    m = marked(spark, sf).withColumn("decada", tx.bucket(tx.year_num("year"), 10))
    flagged = m.where((F.col("decada") > 0) & F.col("es_narco_fuerte"))
    v = un.to_verses(flagged, keys=["song_id", "artist", "song", "year", "decada", "conteo_narco"])
    v = v.withColumn("_neg", -F.col("conteo_narco"))
    return sel.dedupe(v, "verso_texto", ["decada", "_neg", "song_id", "verso_idx"], method="window").drop("_neg")


@register("pool_minus_reviewed")
def pool_minus_reviewed(spark, sf):
    p = jn.minus(pool(spark, sf), reviews(spark, sf))
    return p.select("song_id", "artist", "song", "year", "verso_idx", "verso_texto")


@register("neighbour_context")
def neighbour_context(spark, sf):
    p = pool_minus_reviewed(spark, sf)
    return sel.neighbour_context(p).select("song_id", "verso_idx", "texto_contexto")


def first_lyrics(spark, sf):
    s = load_songs(spark, sf).select("artist", "song", "song_id", "lyrics")
    return sel.dedupe(s, F.concat_ws("\u0001", "artist", "song"), ["song_id"]).drop("song_id")


@register("attach_lyrics_left")
def attach_lyrics_left(spark, sf):
    d = ru.song_density_inline(load_songs(spark, sf), LEX)
    return r6(jn.attach(d, load_songs(spark, sf), how="left").select("artist", "song", "densidad_agenciamiento", "lyrics"))


@register("attach_lyrics_inner")
def attach_lyrics_inner(spark, sf):
    d = ru.density_threshold(ru.song_density_inline(load_songs(spark, sf), LEX), DENSITY_SERIES)
    return r6(jn.attach(d, load_songs(spark, sf), how="inner").where(F.col("lyrics").isNotNull())
              .select("artist", "song", "densidad_agenciamiento", "lyrics"))


@register("lookup_last_wins")
def lookup_last_wins(spark, sf):
    r = jn.lookup_last(reviews(spark, sf), load_songs(spark, sf))
    return r.select("song_id", "verso_idx", "song", F.length(F.coalesce("_l", F.lit(""))).alias("lyrics_len"))


def truth(spark, sf) -> DataFrame:
    return ru.song_truth(review_rows(spark, sf))


@register("song_truth")
def song_truth(spark, sf):
    return truth(spark, sf)


def truth_density(spark, sf) -> DataFrame:
    return jn.truth(truth(spark, sf), song_rollup(spark, sf))


@register("truth_join")
def truth_join(spark, sf):
    return r6(truth_density(spark, sf))


@register("reviewed_only")
def reviewed_only(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("song_id"), F.col("quality").alias("es_util_real"))
    s = load_songs(spark, sf).select("song_id").join(lab, "song_id", "left")
    return ru.reviewed_only(s)


# ------------------------------------------------------------------------------------------ time series, stats
from cantoria.operators import stats as st  # noqa: E402

AVG_COLS = [f"{c}_avg" for c in INTENSITY_COLS]


def series_base(spark, sf) -> DataFrame:
    """Songs with density >= 0.0333 and a numeric year in 1970..2025 (the series stages' input)."""
    r = song_rollup(spark, sf).withColumn("year_n", year_num("year"))
    return (r.where((F.col("densidad_semantica_v2") >= DENSITY_SERIES) & F.col("year_n").between(1970, 2025))
            .withColumn("year", F.col("year_n").cast("int")).drop("year_n"))


@register("centered_smooth")
def centered_smooth(spark, sf):
    y = ru.yearly_means(song_rollup(spark, sf))
    cols = ["densidad_semantica_v2"] + AVG_COLS
    w = Window.orderBy("year").rowsBetween(-1, 1)       # one row per year: a few dozen rows
    return r6(y.select("year", *[F.avg(c).over(w).alias(c) for c in cols]))


@register("shannon_entropy")
def shannon_entropy(spark, sf):
    return r6(st.shannon_entropy(series_base(spark, sf), "year", AVG_COLS))


@register("entropy_bootstrap")
def entropy_bootstrap(spark, sf):
    return r6(st.entropy_bootstrap(series_base(spark, sf), "year", AVG_COLS, order="song_id"))


@register("entropy_bootstrap_tree")
def entropy_bootstrap_tree(spark, sf):
    """X2, exact resampling without a row per draw: multinomial counts of the distinct score vectors."""
    return r6(st.entropy_bootstrap_counts(series_base(spark, sf), "year", AVG_COLS))


@register("js_divergence")
def js_divergence(spark, sf):
    b = series_base(spark, sf).withColumn("lustro", bucket(F.col("year"), 5))
    return r6(st.js_divergence(b, "lustro", AVG_COLS))


@register("kruskal_wallis")
def kruskal_wallis(spark, sf):
    r = song_rollup(spark, sf).withColumn("year_n", year_num("year")).where(F.col("year_n").between(1970, 2025))
    r = r.withColumn("decada", bucket(F.col("year_n"), 10))
    return r6(st.kruskal_wallis(r, "densidad_semantica_v2", "decada"))


@register("kruskal_wallis_test")
def kruskal_wallis_test(spark, sf):
    r = song_rollup(spark, sf).withColumn("year_n", year_num("year")).where(F.col("year_n").between(1970, 2025))
    r = r.withColumn("decada", bucket(F.col("year_n"), 10))
    return st.kruskal_test(r, "densidad_semantica_v2", "decada")


@register("roc_auc")
def roc_auc(spark, sf):
    return r6(st.roc_auc(truth_density(spark, sf), "es_util_real", "densidad_semantica_v2"))


@register("pr_f1_threshold")
def pr_f1_threshold(spark, sf):
    return r6(st.pr_f1_threshold(truth_density(spark, sf), "es_util_real", "densidad_semantica_v2"))


@register("classification_report")
def classification_report(spark, sf):
    t = truth_density(spark, sf).withColumn("pred", (F.col("densidad_semantica_v2") >= DENSITY_SERIES).cast("int"))
    return r6(st.classification_report(t, "es_util_real", "pred"))


# ------------------------------------------------------------------------------------ samples and review sheets
@register("capped_group_sample")
def capped_group_sample(spark, sf):
    pct = density_percent(song_rollup(spark, sf)).where(F.col("densidad_porcentual").between(1, 7))
    stz = un.to_stanzas(load_songs(spark, sf), keys=["song_id"]).join(
        pct.select("song_id", "densidad_porcentual"), "song_id")
    return sel.quota_sample(stz, "densidad_porcentual", "song_id", "texto_entrenamiento", "estrofa_no", 50, 2)


@register("one_stanza_per_song")
def one_stanza_per_song(spark, sf):
    s = load_songs(spark, sf).where(year_num("year").between(2015, 2025))
    stz = un.to_stanzas(s, keys=["song_id"])
    return sel.sample_units(stz, "song_id", "estrofa_no", 70, 1)


@register("ordered_distinct_units")
def ordered_distinct_units(spark, sf):
    arr = sel.ordered_distinct_units(un.stanza_array(tx.normalize_text("lyrics")))
    return load_songs(spark, sf).select("song_id", F.posexplode(arr).alias("pos", "texto_entrenamiento"))


@register("order_by_year_or_density")
def order_by_year_or_density(spark, sf):
    d = ru.song_density_inline(load_songs(spark, sf), LEX)
    return r6(d.where(F.col("densidad_agenciamiento") >= 0.08)
              .select("artist", "song", "year", "densidad_agenciamiento")
              .orderBy(F.desc("densidad_agenciamiento"), "artist", "song"))


@register("order_by_year")
def order_by_year(spark, sf):
    """T2, the other order: every song with its density, oldest first (songs without a year last)."""
    d = ru.song_density_inline(load_songs(spark, sf), LEX)
    return r6(d.select("artist", "song", "year", "total_versos", "densidad_agenciamiento")
              .orderBy(year_num("year").asc_nulls_last(), "artist", "song"))


def dim_matches(spark, sf) -> DataFrame:
    v = un.to_verses(load_songs(spark, sf))
    hits = F.array(*[F.when(F.coalesce(F.col("verso_texto").rlike(lx.dimension_regex(LEX[d])), F.lit(False)),
                            F.lit(d)) for d in DIMS])
    return v.select("*", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("dim"))


@register("seeded_sample")
def seeded_sample(spark, sf):
    m = dim_matches(spark, sf)
    return sel.sample_n(m, 100, ["dim", "song_id", "verso_idx"], by="dim").select(
        "dim", "song_id", "verso_idx", "verso_texto")


@register("review_sheet")
def review_sheet(spark, sf):
    s = seeded_sample(spark, sf)
    return sel.review_sheet(s, ["dim", "song_id", "verso_idx", "verso_texto"])


@register("union_training")
def union_training(spark, sf):
    base = gold(spark, sf).select("verso_texto", *LABEL_COLS)
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("song_id"))
    stz = un.to_stanzas(load_songs(spark, sf).join(lab, "song_id"), keys=["song_id"])
    new = lx.score_units(stz, LEX, text_col="texto_entrenamiento").select(
        F.col("texto_entrenamiento").alias("verso_texto"), F.col("intensidad_AR").alias("val_AR"),
        F.col("intensidad_GO").alias("val_GO"))
    u = base.unionByName(new, allowMissingColumns=True)
    return u.select("verso_texto", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in LABEL_COLS])


@register("scan_reviews_union")
def scan_reviews_union(spark, sf):
    return reviews(spark, sf)


@register("label_max_pool")
def label_max_pool(spark, sf):
    return gold(spark, sf)


@register("label_merge_by_file_dim")
def label_merge_by_file_dim(spark, sf):
    r = review_rows(spark, sf)
    val = F.element_at(F.array(*[F.col(c) for c in LABEL_COLS]),
                       (F.array_position(F.array(*[F.lit(d) for d in DIMS]), F.col("dim_archivo"))).cast("int"))
    long = r.select("artist", "song", "verso_texto", F.col("dim_archivo").alias("dim"), val.alias("valor"))
    return ru.label_merge_by_file_dim(long)


@register("song_condense")
def song_condense(spark, sf):
    return ru.song_condense(scored_verses(spark, sf))


@register("label_histogram")
def label_histogram(spark, sf):
    return r6(ru.label_histogram(gold(spark, sf), LABEL_COLS))


@register("origin_decade_counts")
def origin_decade_counts(spark, sf):
    return ru.decade_counts(reviews(spark, sf))


@register("top_artists")
def top_artists(spark, sf):
    return ru.top_n(reviews(spark, sf), "artist", 15)


@register("label_correlation")
def label_correlation(spark, sf):
    return r6(st.correlation_pairs(gold(spark, sf), LABEL_COLS))


@register("facet_counts")
def facet_counts(spark, sf):
    dom, mx = sc.dominant_dimension("val_")
    g = gold(spark, sf).select(bucket(year_num("year"), 10).alias("decada"), dom.alias("dimension_dominante"),
                               mx.alias("_mx")).where(F.col("_mx") > 0)
    return g.groupBy("decada", "dimension_dominante").agg(F.count(F.lit(1)).alias("n"))


@register("year_kde")
def year_kde(spark, sf):
    r = reviews(spark, sf).withColumn("year_n", year_num("year"))
    return r6(st.gaussian_kde(r, "origen", "year_n", 1970, 2025).withColumnRenamed("x", "year"))


@register("flow_stats")
def flow_stats(spark, sf):
    """Review counts per origin, after max-pool dedupe, after per-decade balancing (each decade topped up to
    the largest; skipped when the smallest decade has one row), synthetic rows."""
    r = reviews(spark, sf)
    return ru.flow_stats(r.where(F.col("origen") == "Regex"), r.where(F.col("origen") == "K-Means"), gold(spark, sf), balanced(spark, sf))


# ----------------------------------------------------------------------------------------------------- vectors
from cantoria.operators import attractors as att  # noqa: E402
from cantoria.operators import boosting as bo  # noqa: E402
from cantoria.operators import learn as ml  # noqa: E402
from cantoria.operators import vectors as vx  # noqa: E402


def hashed(df: DataFrame, text_col: str) -> DataFrame:
    """Hash-encoded, unit-length vectors of a text column (M3 + M4)."""
    return df.withColumn("_raw", vx.hash_encode(F.col(text_col))).withColumn("vec", vx.l2_normalize(F.col("_raw"))).drop("_raw")


def long_vector(df: DataFrame, keys: list[str], vec: str, name: str = "valor") -> DataFrame:
    return (df.select(*keys, F.posexplode(vec).alias("pos", name)).where(F.col(name) != 0))


@register("encode_units")
def encode_units(spark, sf):
    v = un.to_verses(load_songs(spark, sf)).withColumn("raw", vx.hash_encode(F.col("verso_texto")))
    return (long_vector(v, ["song_id", "verso_idx"], "raw", "n")
            .select("song_id", "verso_idx", F.col("pos").alias("bucket"), F.col("n").cast("int").alias("n")))


@register("l2_normalize")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("u", vx.l2_normalize(F.col("e")))
    return r6(e.select("vec_id", vx.norm(F.col("e")).alias("norma"), F.col("u")[0].alias("x0"),
                       F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("suma_unitaria")))


def anchors(spark, sf) -> DataFrame:
    """Per dimension: reviewed verses with a positive label, weighted by it, with hash vectors."""
    g = hashed(gold(spark, sf), "verso_texto")
    stack = F.expr("stack(6, " + ", ".join(f"'{d}', val_{d}" for d in DIMS) + ") as (dim, peso)")
    return g.select("verso_texto", "vec", stack).where(F.col("peso") > 0)


def centroids(spark, sf) -> DataFrame:
    return vx.weighted_centroid(anchors(spark, sf), "dim", "vec", "peso")


@register("weighted_centroid")
def weighted_centroid(spark, sf):
    return r6(long_vector(centroids(spark, sf), ["dim"], "centroide"))


def topk(spark, sf) -> DataFrame:
    p = hashed(pool_minus_reviewed(spark, sf), "verso_texto")
    return vx.similarity_topk(p, centroids(spark, sf).withColumn("k_idx", F.lit(0)), "vec",
                              ["song_id", "verso_idx"], ["dim"], k=1000)


@register("similarity_topk")
def similarity_topk(spark, sf):
    return r6(topk(spark, sf).select("dim", "song_id", "verso_idx", "rank", "similitud_coseno"))


@register("similarity_band")
def similarity_band(spark, sf):
    return r6(vx.band(topk(spark, sf)).select("dim", "song_id", "verso_idx", "rank", "similitud_coseno"))


@register("score_distribution")
def score_distribution(spark, sf):
    return r6(st.quartiles(topk(spark, sf), "dim", "similitud_coseno"))


def attractor_set(spark, sf) -> DataFrame:
    """M5 with its fallback: up to five attractors per dimension; a dimension without anchors gets the vector of its
    lexicon terms."""
    def build():
        found = att.weighted_attractors(anchors(spark, sf), "dim", "vec", "peso")
        terms = spark.createDataFrame([(d, " ".join(sorted(set(LEX[d])))) for d in DIMS], "dim string, terminos string")
        alone = hashed(terms.join(found.select("dim").distinct(), "dim", "left_anti"), "terminos")
        return found.unionByName(alone.select("dim", F.lit(0).alias("k_idx"), F.col("vec").alias("centroide")))
    return stage(("attractor_set", sf), build)


def attractor_candidates(spark, sf) -> DataFrame:
    """J7 over the context of every pooled verse (W1): what the pick needs travels with the search, nothing is joined
    back."""
    pool_ = sel.neighbour_context(pool_minus_reviewed(spark, sf)).withColumn("decada", bucket(year_num("year", default=2000), 10))
    return vx.similarity_topk(hashed(pool_, "texto_contexto"), attractor_set(spark, sf), "vec",
                              ["song_id", "verso_idx", "artist", "verso_texto", "decada"], ["dim", "k_idx"], k=1000)


@register("attractor_search")
def attractor_search(spark, sf):
    """M5 -> J7: the nearest contexts of every attractor."""
    return r6(attractor_candidates(spark, sf).select("dim", "k_idx", "song_id", "verso_idx", "rank", "similitud_coseno"))


@register("diverse_round_robin")
def diverse_round_robin(spark, sf):
    """M5 -> J7 -> W7: the diverse pick of every dimension from all of its attractors."""
    cands = attractor_candidates(spark, sf).withColumnRenamed("k_idx", "attractor")
    return sel.diverse_round_robin(cands, target=100, lo=0.20, hi=0.90)


@register("vector_cache")
def vector_cache(spark, sf):
    """The verses of labelled songs are encoded into a cache first; then all verses ask for their vectors: what
    the cache holds is read back, the rest is encoded and added."""
    path = _scratch(spark, "vector-cache")
    encode = lambda df: hashed(df, "verso_texto")
    labelled = load_songs(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("song_id")), "song_id", "left_semi")
    vx.cached_vectors(un.to_verses(labelled), "verso_texto", path, "hash64", encode)
    out = vx.cached_vectors(un.to_verses(load_songs(spark, sf)), "verso_texto", path, "hash64", encode)
    return out.select("clave", "desde_cache")


@register("weighted_attractors")
def weighted_attractors(spark, sf):
    """M5: the attractors of every dimension, best of ten starts, number of clusters by the exact silhouette."""
    return r6(att.weighted_attractors(anchors(spark, sf), "dim", "vec", "peso").select("dim", "k_idx", F.posexplode("centroide").alias("pos", "valor")))


@register("knn_within_class")
def knn_within_class(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return r6(vx.knn_exact(e, "vec_id", "v", "label", k=5))


def balanced(spark, sf) -> DataFrame:
    """M7 output: the gold rows and the synthetic ones. Rows are numbered in the order of their texts, so that neighbours
    are found and drawn by number and no text travels with them."""
    g = gold(spark, sf).select("verso_texto", *LABEL_COLS, bucket(year_num("year", default=2000), 10).alias("decada"))
    g = written(hashed(vx.numbered(g, "verso_texto", "_fila"), "verso_texto"), "gold-vectors")
    drawn = vx.draws(g, "verso_texto", "decada", key="_fila")
    nb = vx.knn_exact(g, "_fila", "vec", "decada", k=5, asked=drawn)
    return vx.oversample(g, "verso_texto", "vec", LABEL_COLS, "decada", nb, key="_fila", drawn=drawn)


@register("oversample_interpolate")
def oversample_interpolate(spark, sf):
    """M7: the real rows and the synthetic ones, with their vectors and labels."""
    return r6(balanced(spark, sf).select("decada", "verso_texto", "sintetico", "vec", *LABEL_COLS))


# ----------------------------------------------------------------------------------------------------- learning
def clean_tokens(spark, sf) -> DataFrame:
    stop = sorted(set(STOPWORDS_ES))
    return load_songs(spark, sf).select("song_id", F.filter(tx.tokens("lyrics", "word"), lambda t: ~t.isin(stop)).alias("term"))


@register("tfidf")
def tfidf_q(spark, sf):
    return r6(ml.tfidf(clean_tokens(spark, sf), "song_id", max_features=5000))


def clustered(spark, sf):
    stop = sorted(set(STOPWORDS_ES))
    docs = load_songs(spark, sf).select("song_id", F.filter(tx.tokens("lyrics", "word"), lambda t: ~t.isin(stop))
                                        .alias("tok"))
    assign, _ = ml.cluster(ml.tfidf_vectors(docs, "tok", 5000), k=15)
    return assign.select("song_id", "cluster")


@register("cluster_documents")
def cluster_documents(spark, sf):
    return clustered(spark, sf)


@register("cluster_profile")
def cluster_profile(spark, sf):
    long = ml.tfidf(clean_tokens(spark, sf), "song_id", max_features=5000)
    return ml.cluster_profile(long, clustered(spark, sf), "song_id", drop=[])


@register("drop_clusters")
def drop_clusters_q(spark, sf):
    return ml.drop_clusters(clustered(spark, sf), [0])


@register("silhouette_euclidean")
def silhouette_euclidean(spark, sf):
    """X8 exact: Euclidean distances of all pairs, in blocks."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return r6(att.silhouette(e, "vec_id", "v", "label"))


@register("silhouette")
def silhouette_q(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    score = vx.silhouette(e, "v", "label")
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).withColumn("silueta", F.lit(score))


@register("stratified_split")
def stratified_split(spark, sf):
    s = sel.stratified_split(gold(spark, sf), LABEL_COLS, 0.2, id_col="verso_texto")
    return s.select("verso_texto", "estrato", "split")


def gold_long(spark, sf) -> DataFrame:
    stack = F.expr("stack(6, " + ", ".join(f"'{d}', val_{d}" for d in DIMS) + ") as (dim, label)")
    return gold(spark, sf).select("verso_texto", stack)


@register("balanced_weights")
def balanced_weights(spark, sf):
    return r6(ml.balanced_weights(gold_long(spark, sf), "label", by="dim").select("dim", "label", "peso").distinct())


@register("label_index")
def label_index(spark, sf):
    """Forward map of every (dimension, class); the label is read back through the inverse map."""
    g = gold_long(spark, sf)
    forward = ml.label_index(g, "label", by="dim").select("dim", "indice").distinct()
    return ml.label_decode(forward, ml.label_map(g, "label", by="dim"), "label", by="dim").select("dim", "label", "indice")


def trained(spark, sf):
    from cantoria.session import cut_lineage
    # one reliable checkpoint of the (review-sized) training table: six model fits read it instead of
    # re-deriving it from the corpus each time; vectors are made after the split, so none is shuffled
    split = cut_lineage(hashed(sel.stratified_split(gold(spark, sf), LABEL_COLS, 0.2, id_col="verso_texto"), "verso_texto"))
    train = split.where(F.col("split") == "train")
    models = ml.train_multilabel(train, "vec", LABEL_COLS, depth=4)
    return split, models


@register("train_multilabel")
def train_multilabel(spark, sf):
    split, models = trained(spark, sf)
    test = split.where(F.col("split") == "test")
    # six reports read the scores: the rows are scored once
    scored = cut_lineage(ml.score_units(test.select("vec", *LABEL_COLS), "vec", models, prefix="pred_").drop("vec"))
    out = None
    for d in DIMS:
        one = ml.accuracy_report(scored, f"val_{d}", f"pred_{d}").withColumn("dim", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return r6(out)


@register("score_units")
def score_units_q(spark, sf):
    _, models = trained(spark, sf)
    p = hashed(pool_minus_reviewed(spark, sf), "verso_texto")
    return ml.score_units(p, "vec", models).select("song_id", "verso_idx", *[f"intensidad_{d}" for d in DIMS])


#: step x rounds as in the study (0.01 x 1,500), in fewer and larger steps; patience in proportion
BOOSTING = {"rounds": 50, "step": 0.3, "patience": 5}


def boosted(spark, sf, labels):
    split = cut_lineage(hashed(sel.stratified_split(gold(spark, sf), LABEL_COLS, 0.2, id_col="verso_texto"), "verso_texto"))
    return split, bo.train(split, "vec", labels, held=F.col("split") == "test", **BOOSTING)


@register("train_multilabel_boosted")
def train_multilabel_boosted(spark, sf):
    """M10 as the study trains it: six boosted models, stopped on the test rows (as there), beside the forests."""
    split, model = boosted(spark, sf, LABEL_COLS)
    forests = ml.train_multilabel(split.where(F.col("split") == "train"), "vec", LABEL_COLS, depth=4)
    test = split.where(F.col("split") == "test").select("vec", *LABEL_COLS)
    test = bo.score(ml.score_units(test, "vec", forests, prefix="bosque_"), "vec", model)
    # twelve reports read the scores: the rows are scored once
    test = cut_lineage(test.drop("vec"))
    out = None
    for c, d in zip(LABEL_COLS, DIMS):
        forest = ml.accuracy_report(test, c, f"bosque_{d}").select(F.col("exactitud").alias("bosque"), F.col("exactitud_balanceada").alias("bosque_balanceada"))
        one = st._one_row_join(ml.accuracy_report(test, c, f"pred_{d}"), forest).withColumn("dim", F.lit(d)).withColumn("rondas", F.lit(model.best[c]))
        out = one if out is None else out.unionByName(one)
    return r6(out)


@register("score_units_boosted")
def score_units_boosted(spark, sf):
    """M12 with the boosted models: every unreviewed verse with its six intensities."""
    _, model = boosted(spark, sf, LABEL_COLS)
    p = hashed(pool_minus_reviewed(spark, sf), "verso_texto").select("song_id", "verso_idx", "vec")
    return bo.score(p, "vec", model, "intensidad_").drop("vec")


@register("word_attribution")
def word_attribution(spark, sf):
    """M17 of a trained model: Shapley values of the highest intensity of AR, per word of the reviewed verses that have it."""
    split, model = boosted(spark, sf, ["val_AR"])
    top = model.classes["val_AR"][-1]
    found = bo.explain(split.where(F.col("val_AR") == top).select("verso_texto", "vec"), "vec", model, "val_AR", top)
    return r6(bo.word_contributions(found, "verso_texto", tx.tokens("verso_texto", "runs")))


@register("project_low_dim")
def project_low_dim(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return ml.project(e, "v", 3).select("vec_id", "c1", "c2", "c3")


@register("project_neighbours")
def project_neighbours(spark, sf):
    """M13 by the neighbour graph: three coordinates that keep neighbourhoods, for every vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return r6(ly.spectral_layout(e, "vec_id", "v", 3).select("vec_id", "c1", "c2", "c3"))


def dense_lyrics(spark, sf) -> DataFrame:
    """Vectors of the lyrics of the songs above the density threshold (no text is kept)."""
    dense = ru.density_threshold(ru.song_density_inline(load_songs(spark, sf), LEX, unit="verse")).select("artist", "song")
    # encoded before the join: vectors are shuffled by the song, lyrics are not
    vectors = hashed(load_songs(spark, sf), "lyrics").select("song_id", "artist", "song", "year", "vec")
    return vectors.join(dense, ["artist", "song"], "left_semi").select("song_id", "year", "vec")


def text_topics(spark, sf) -> DataFrame:
    """Songs above the density threshold with the topic of their lyrics around centres (keys only)."""
    return stage(("text_topics", sf), lambda: ml.topic_model(dense_lyrics(spark, sf), "vec", k=8, min_size=15).drop("vec"))


BROADCAST_SONGS = 4_000_000          # (number, topic, bin): about 50 bytes each in a task's memory


def lyric_grams(spark, sf, docs: DataFrame) -> DataFrame:
    stop = sorted({_strip_py(w) for w in STOPWORDS_ES})
    tok = F.filter(tx.word_runs(tx.strip_accents(F.lower("lyrics"))), lambda t: ~t.isin(stop))
    # song numbers and topics go to the lyrics as long as they are few; otherwise the lyrics, not their tokens, are shuffled
    topics = F.broadcast(docs) if docs.limit(BROADCAST_SONGS + 1).count() <= BROADCAST_SONGS else docs
    words = load_songs(spark, sf).select("song_id", "lyrics").join(topics, "song_id").withColumn("_tok", tok)
    return words.select(*[c for c in docs.columns if c != "song_id"], F.explode(un.ngram_array(F.col("_tok"), 1, 2)).alias("ngram"))


@register("topic_model")
def topic_model(spark, sf):
    """M14 on the lyrics of the songs above the threshold: density clusters, -1 for noise."""
    return ml.density_topic_model(dense_lyrics(spark, sf), "song_id", "vec", min_size=15).select("song_id", "topic")


@register("topic_model_centres")
def topic_model_centres(spark, sf):
    """M14 around k-means centres: the topics that ``topic_info`` and ``topic_trend`` describe."""
    return text_topics(spark, sf).select("song_id", "topic")


@register("topic_info")
def topic_info(spark, sf):
    """M15 on the text topics: count, name and terms of every topic."""
    docs = text_topics(spark, sf).select("song_id", "topic")
    return ml.topic_info(docs, lyric_grams(spark, sf, docs))


@register("topic_trend")
def topic_trend(spark, sf):
    """M16 on the text topics: documents and terms of every topic in 20 bins of 1980-2025."""
    docs = text_topics(spark, sf).withColumn("year_n", year_num("year")).where(F.col("year_n").between(1980, 2025))
    docs = docs.select("song_id", "topic", ml.time_bins("year_n", 1980, 2025, 20).alias("bin"))
    return ml.topic_trend(docs, lyric_grams(spark, sf, docs))


def topic_grams(spark, sf) -> DataFrame:
    dom, mx = sc.dominant_dimension("val_")
    stop = sorted({_strip_py(w) for w in STOPWORDS_ES})
    g = gold(spark, sf).select("verso_texto", "year", dom.alias("topic"), mx.alias("_mx")).where(F.col("_mx") > 0)
    tok = F.filter(tx.word_runs(tx.strip_accents(F.lower("verso_texto"))), lambda t: ~t.isin(stop))
    return g.select("topic", "year", tok.alias("_tok")).select(
        "topic", "year", F.explode(un.ngram_array(F.col("_tok"), 1, 2)).alias("ngram"))


@register("class_tfidf")
def class_tfidf(spark, sf):
    return r6(ml.class_tfidf(topic_grams(spark, sf), "topic", "ngram", top=10))


@register("topics_over_time")
def topics_over_time(spark, sf):
    """M16 with given topics (the dominant dimension): documents and terms per topic and bin."""
    binned = lambda df: (df.withColumn("year_n", year_num("year")).where(F.col("year_n").between(1980, 2025))
                         .withColumn("bin", ml.time_bins("year_n", 1980, 2025, 20)))
    dom, mx = sc.dominant_dimension("val_")
    g = gold(spark, sf).select("year", dom.alias("topic"), mx.alias("_mx")).where(F.col("_mx") > 0)
    return ml.topic_trend(binned(g).select("topic", "bin"), binned(topic_grams(spark, sf)).select("topic", "bin", "ngram"))


@register("token_attribution")
def token_attribution(spark, sf):
    terms = sorted(set(LEX["AR"]))

    def score(text):
        return F.least(F.size(F.filter(tx.word_runs(text), lambda t: t.isin(terms))), F.lit(3))
    return ml.token_attribution(gold(spark, sf).where(F.col("val_AR") > 0), "verso_texto", "verso_texto", score)


@register("projection_frame")
def projection_frame(spark, sf):
    """Rows with year > 1900 sorted by year, marker size = max intensity * 3, axis bounds min-1 / max+1,
    decade label '1970s'."""
    r = song_rollup(spark, sf).withColumn("year_n", year_num("year")).where(F.col("year_n") > 1900)
    r = r.where(F.col("total_estrofas").isNotNull())
    xs = ["intensidad_AR_avg", "intensidad_MO_avg", "intensidad_DI_avg"]
    bounds = r.agg(*[(F.min(c) - 1).alias(f"{c}_lo") for c in xs], *[(F.max(c) + 1).alias(f"{c}_hi") for c in xs])
    mx = F.greatest(*[F.col(f"{c}_max") for c in INTENSITY_COLS])
    out = st._one_row_join(r.select("song_id", "year_n", *xs, mx.alias("_mx")), bounds)
    return r6(out.select("song_id", F.col("year_n").cast("int").alias("year"),
                         F.concat(bucket(F.col("year_n"), 10).cast("string"), F.lit("s")).alias("decada"),
                         (F.col("_mx") * 3).alias("tamano"), *xs, *[f"{c}_lo" for c in xs], *[f"{c}_hi" for c in xs])
              .orderBy("year", "song_id"))


# ---------------------------------------------------------------------------------------------------- streaming
from cantoria.streaming import ingest as stream  # noqa: E402


@register("incremental_ingest")
def incremental_ingest(spark, sf):
    """The documents file streamed through ingest (length >= 150, fingerprint dedupe against the target)."""
    target, q = stream.ingest_stream(spark, stream.table_files(sf), glob=None)
    stream.run_to_completion(q)
    return spark.read.parquet(target).select("song_id", "artist", "song", "year", "huella")


@register("incremental_ingest_stateful")
def incremental_ingest_stateful(spark, sf):
    """R1 with the fingerprints in keyed streaming state."""
    target, q = stream.ingest_stateful(spark, stream.table_files(sf), glob=None)
    stream.run_to_completion(q)
    return spark.read.parquet(target).select("song_id", "artist", "song", "year", "huella")


@register("incremental_rollup")
def incremental_rollup(spark, sf):
    """R2: per-year counters maintained by a streaming aggregation; mean density = sum / songs with stanzas."""
    target, q = stream.rollup_stream(spark, stream.table_files(sf), glob=None)
    stream.run_to_completion(q)
    r = spark.read.parquet(target)
    return r6(r.select("year", "canciones", "estrofas", "activas",
                       (F.col("suma_densidad") / F.col("con_estrofas")).alias("densidad_media")))


# ------------------------------------------------------------------------------------------------ P1, P15, W8
@register("normalize_text")
def normalize_text_q(spark, sf):
    """NFKC + strip of every lyric (Arrow UDF)."""
    return load_songs(spark, sf).select("song_id", tx.normalize_text("lyrics").alias("lyrics_limpia"))


@register("unit_active")
def unit_active(spark, sf):
    """Verse is active when any dimension scores > 0."""
    return scored_verses(spark, sf).select("song_id", "verso_idx", is_active().alias("verso_es_activo"))


@register("period_lag")
def period_lag(spark, sf):
    """Each lustrum with the previous *existing* one (songs per lustrum and the previous lustrum's count)."""
    b = series_base(spark, sf).withColumn("lustro", bucket(F.col("year"), 5))
    per = b.groupBy("lustro").agg(F.count(F.lit(1)).alias("canciones"))
    w = Window.orderBy("lustro")        # one row per lustrum
    return per.select("lustro", "canciones", F.lag("lustro").over(w).alias("lustro_previo"),
                      F.lag("canciones").over(w).alias("canciones_previas"))


@register("entropy_bootstrap_poisson")
def entropy_bootstrap_poisson(spark, sf):
    """X2 scale variant: Poisson(1) replicate weights from md5(year, song, rep) — no numbering, no join."""
    return r6(st.entropy_bootstrap(series_base(spark, sf), "year", AVG_COLS, order="song_id", method="poisson"))


@register("flow_edges")
def flow_edges(spark, sf):
    """A19 edges (source, target, value) of the flow diagram, from the flow counters."""
    return ru.flow_edges(flow_stats(spark, sf))


@register("word_frequency_raw")
def word_frequency_raw(spark, sf):
    """A1: the 30 most frequent tokens, stop words included."""
    toks = load_songs(spark, sf).select(F.explode(tx.tokens("lyrics", "word")).alias("term"))
    return ru.top_n(toks, "term", 30)


# ---------------------------------------------------------------------------------------------------- sinks
import uuid  # noqa: E402

from cantoria.session import ensure_checkpoint_dir  # noqa: E402
from cantoria.sources import sinks  # noqa: E402


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register("write_stage")
def write_stage(spark, sf):
    """The marked song table written as a stage (overwrite, partitioned by decade) and read back."""
    path = _scratch(spark, "stage")
    m = load_songs(spark, sf).select("song_id", "artist", "song", "year",
                                     bucket(year_num("year"), 10).alias("decada"))
    sinks.save(m, path, partition_by=["decada"])
    return spark.read.parquet(path).select("song_id", "artist", "song", "year", F.col("decada").cast("int"))


@register("write_if_absent")
def write_if_absent(spark, sf):
    """A review sheet is written once; a second write of another sample is ignored (human work kept)."""
    path = _scratch(spark, "sheet")
    sheet = seeded_sample(spark, sf).select("dim", "song_id", "verso_idx")
    sinks.save(sheet, path, if_absent=True)
    sinks.save(sheet.limit(0), path, if_absent=True)
    return spark.read.parquet(path)


@register("append_batches")
def append_batches(spark, sf):
    """S3: the song table appended in two batches (ids below / from the median id) and read back whole."""
    path = _scratch(spark, "append")
    s = load_songs(spark, sf).select("song_id", "artist", "song")
    mid = s.agg(F.percentile_approx("song_id", 0.5)).first()[0]
    sinks.append(s.where(F.col("song_id") < mid), path)
    sinks.append(s.where(F.col("song_id") >= mid), path)
    return spark.read.parquet(path)


@register("scan_songs_csv")
def scan_songs_csv(spark, sf):
    """S1 on a real CSV file: the songs written with a header, in another column order, and read back by name."""
    path = _scratch(spark, "songs-csv")
    cols = ["album", "lyrics", "song", "song_id", "artist", "year"]
    load_songs(spark, sf).select(cols).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_songs(spark, path, fmt="csv").select("song_id", "artist", "album", "year", "song", "lyrics")


@register("scan_reviews_files")
def scan_reviews_files(spark, sf):
    """S2 on real files: one sheet per dimension and origin, each with its own label column only, united by name."""
    from cantoria.sources.reviews import ORIGIN_KMEANS, read_reviews
    folder = _scratch(spark, "sheets")
    base = ["song_id", "artist", "song", "year", "verso_idx", "verso_texto"]
    rows = stage(("sheet_rows", sf), lambda: review_rows(spark, sf).select(*base, "origen", "dim_archivo", *[f"val_{d}" for d in DIMS]))
    paths = []
    for d in DIMS:
        for marked, name in ((True, f"{folder}/revision_{d}_v2"), (False, f"{folder}/revision_{d}")):
            own = rows.where((F.col("dim_archivo") == d) & ((F.col("origen") == ORIGIN_KMEANS) == F.lit(marked))).select(*base, f"val_{d}")
            own.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(name)
            paths.append(name)
    out = read_reviews(spark, paths)
    return out.select(F.col("song_id").cast("bigint").alias("song_id"), "artist", "song", "year", F.col("verso_idx").cast("int").alias("verso_idx"),
                      "verso_texto", "origen", *[F.col(f"val_{d}").cast("int").alias(f"val_{d}") for d in DIMS])


@register("flow_stats_file")
def flow_stats_file(spark, sf):
    """The flow counters written as a JSON object and read back."""
    path = _scratch(spark, "flow-json")
    stats = flow_stats(spark, sf)
    sinks.write_flow_stats(stats, path)
    return spark.read.schema(stats.schema).json(path)


def hashing_encoder():
    """A pluggable encoder with the rule of ``hash_encode``: counts of md5 buckets of the tokens."""
    import hashlib
    from functools import lru_cache

    import numpy as np

    @lru_cache(maxsize=1 << 16)
    def bucket_of(t):
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % vx.HASH_DIM

    def encode(texts):
        found = [[bucket_of(t) for t in text.split(" ") if t != ""] for text in texts]
        row = np.repeat(np.arange(len(texts)) * vx.HASH_DIM, [len(f) for f in found])
        cells = row + np.array([b for f in found for b in f], dtype=np.int64)
        return np.bincount(cells, minlength=len(texts) * vx.HASH_DIM).reshape(len(texts), vx.HASH_DIM)
    return encode


@register("encode_units_plugged")
def encode_units_plugged(spark, sf):
    """M3 through the pluggable hook: the tokens of every verse, joined by spaces, encoded batch by batch in Python."""
    v = un.to_verses(load_songs(spark, sf)).select("song_id", "verso_idx", F.array_join(tx.tokens("verso_texto", "runs"), " ").alias("_tok"))
    v = vx.encode_with(v, "_tok", hashing_encoder, "raw")
    return (long_vector(v, ["song_id", "verso_idx"], "raw", "n")
            .select("song_id", "verso_idx", F.col("pos").alias("bucket"), F.col("n").cast("int").alias("n")))


@register("save_vectors_models")
def save_vectors_models(spark, sf):
    """Vectors and six trained models are saved, loaded and used: every row with the scores of both."""
    path = _scratch(spark, "saved")
    sinks.save_vectors(hashed(gold(spark, sf), "verso_texto").select("verso_texto", "vec", *LABEL_COLS), f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    models = ml.train_multilabel(rows, "vec", LABEL_COLS)
    for c, model in models.items():
        sinks.save_model(model, f"{path}/{c}")
    loaded = {c: sinks.load_model(f"{path}/{c}") for c in models}
    both = ml.score_units(ml.score_units(rows, "vec", models, "a_"), "vec", loaded, "b_")
    return both.select("verso_texto", *[f"{k}_{d}" for d in DIMS for k in "ab"])


@register("facet_margins")
def facet_margins(spark, sf):
    """A20 with margins: rows per decade x dominant dimension, plus per-decade, per-dimension and grand totals
    (``cube``; a null key marks a margin)."""
    dom, mx = sc.dominant_dimension("val_")
    g = gold(spark, sf).select(bucket(year_num("year"), 10).alias("decada"), dom.alias("dimension_dominante"),
                               mx.alias("_mx")).where(F.col("_mx") > 0)
    return (g.cube("decada", "dimension_dominante")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("nivel")))


@register("neighbour_context_lyric")
def neighbour_context_lyric(spark, sf):
    """W1 default scope: previous + current + next verse of the full lyric (in-row, no window, no shuffle)."""
    s = load_songs(spark, sf).select("song_id", un.verse_array("lyrics").alias("_v"))
    return s.select("song_id", F.inline(sel.neighbour_context_inline(F.col("_v"))))


@register("word_frequency_after_clusters")
def word_frequency_after_clusters(spark, sf):
    """A1 third list: top 100 tokens without stop words after dropping the listed noisy clusters."""
    assign = clustered(spark, sf)
    kept = ml.drop_clusters(assign, [0]).select("song_id")
    stop = sorted(set(STOPWORDS_ES))
    toks = (load_songs(spark, sf).join(kept, "song_id", "left_semi")
            .select(F.explode(tx.tokens("lyrics", "word")).alias("term")).where(~F.col("term").isin(stop)))
    return ru.top_n(toks, "term", 100)
