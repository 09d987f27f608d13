"""DuckDB oracle SQL for the registered queries (same tables, same output names and types)."""

from __future__ import annotations

from cantoria.fixed import DIMS, INTENSITY_COLS
from cantoria.operators.rollup import NOISE_LABEL, PASS_LABEL
from cantoria.plans import sqlkit as k

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


R6 = lambda x, a: f"round({x}, 6) AS {a}"

SONG_COLS = "song_id, artist, album, year, song, lyrics"

sql("scan_songs", k.with_(k.SONGS_CTE) + f"SELECT {SONG_COLS} FROM songs")

sql("verse_explode", k.with_(k.SONGS_CTE, k.VERSES_CTE) + "SELECT * FROM verses")

sql("verse_explode_dense", k.with_(k.SONGS_CTE, k.DENSE_CTE) + "SELECT * FROM dense")

sql("stanza_explode", k.with_(k.SONGS_CTE, k.STANZAS_CTE) + "SELECT * FROM stanzas")

sql("lexicon_hits", k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE) + "SELECT * FROM scored_verses")

_DENS = k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE, k.DENSITY_CTE)
_DENS_COLS = ("artist, song, year, total_versos, versos_activos, " + ", ".join(INTENSITY_COLS)
              + ", round(densidad_agenciamiento, 6) AS densidad_agenciamiento")

sql("song_density", _DENS + f"SELECT {_DENS_COLS} FROM density")

sql("density_threshold", _DENS + f"SELECT {_DENS_COLS} FROM density WHERE densidad_agenciamiento >= 0.15")

sql("density_zones", _DENS + f"""
SELECT {k.bucket(k.year_num(), 10)} AS decada,
       CASE WHEN densidad_agenciamiento >= 0.08 THEN 'util' WHEN densidad_agenciamiento > 0 THEN 'gris'
            WHEN densidad_agenciamiento = 0 THEN 'descarte' END AS zona,
       count(*) AS canciones
FROM density GROUP BY ALL""")

sql("filter_audit", _DENS + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE densidad_agenciamiento > 0) AS pasan,
       count(*) FILTER (WHERE coalesce(densidad_agenciamiento, 0) <= 0) AS ruido,
       count(*) FILTER (WHERE densidad_agenciamiento >= 0.08) AS util,
       count(*) FILTER (WHERE densidad_agenciamiento > 0 AND densidad_agenciamiento < 0.08) AS gris,
       count(*) FILTER (WHERE densidad_agenciamiento = 0) AS descarte
FROM density""")

_ROLL = k.with_(k.SONGS_CTE, k.STANZAS_CTE, k.SCORED_STANZAS_CTE, k.ROLLUP_CTE)
_ROLL_COLS = ("total_estrofas, estrofas_activas, " + ", ".join(f"{c}_max" for c in INTENSITY_COLS) + ", "
              + ", ".join(f"round({c}_avg, 6) AS {c}_avg" for c in INTENSITY_COLS)
              + ", round(densidad_semantica_v2, 6) AS densidad_semantica_v2")
_SR = k.with_(k.SONGS_CTE, k.STANZAS_CTE, k.SCORED_STANZAS_CTE, k.ROLLUP_CTE, k.SONG_ROLLUP_CTE)

sql("stanza_rollup", _ROLL + f"SELECT song_id, {_ROLL_COLS} FROM rollup")

sql("rollup_back_to_songs", _SR + f"SELECT song_id, artist, album, year, song, lang, {_ROLL_COLS} FROM song_rollup")

_YEARLY_COLS = ["densidad_semantica_v2"] + [f"{c}_avg" for c in INTENSITY_COLS]
sql("yearly_means", _SR + f"""
SELECT CAST({k.year_num()} AS INTEGER) AS year, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _YEARLY_COLS)}
FROM song_rollup WHERE {k.year_num()} BETWEEN 1970 AND 2025 GROUP BY 1""")

sql("year_category_pivot", _SR + f"""
SELECT CAST({k.year_num()} AS INTEGER) AS year,
       count(*) FILTER (WHERE coalesce(densidad_semantica_v2, 0) > 0) AS "{PASS_LABEL}",
       count(*) FILTER (WHERE NOT coalesce(densidad_semantica_v2, 0) > 0) AS "{NOISE_LABEL}"
FROM song_rollup WHERE {k.year_num()} BETWEEN 1970 AND 2025 GROUP BY 1""")

sql("density_histogram", _SR + """
SELECT bin, count(*) AS n, round((bin - 1) / 40.0, 6) AS lo, round(bin / 40.0, 6) AS hi FROM (
  SELECT CAST(least(floor(40 * densidad_semantica_v2) + 1, 40) AS INTEGER) AS bin
  FROM song_rollup WHERE densidad_semantica_v2 > 0) GROUP BY bin""")

sql("song_fingerprint", k.with_(k.SONGS_CTE) + """
SELECT song_id, regexp_replace(strip_accents(lower(coalesce(artist, '') || coalesce(song, ''))), '[^a-z0-9]', '', 'g')
       AS huella FROM songs""")


# ------------------------------------------------------------------------------------------------- batch 2
from cantoria.fixed import LANG_STOPWORDS, STANDIN_LEXICON, STANDIN_STRONG_TERMS, STOPWORDS_ES  # noqa: E402
from cantoria.plans.sqlkit import q  # noqa: E402

_S = k.with_(k.SONGS_CTE)


# P8 (`\b[a-záéíóúñü0-9-]+\b`, Unicode \b). The text is cut into maximal class runs and single other characters.
# Inside a run, word boundaries exist only where letters/digits meet hyphens, plus at the run's edges when the
# neighbouring character's word-ness differs; the leftmost-greedy match is then one token per run, from the first
# boundary to the last (none when the run has fewer than two boundaries).
def _p8_tokens(text: str) -> str:
    segs = f"regexp_extract_all(lower({text}), '[a-záéíóúñü0-9-]+|[^a-záéíóúñü0-9-]')"
    word = "regexp_full_match({c}, '[\\p{{L}}\\p{{N}}_]')"
    run = "s[i]"
    wp = f"coalesce(CASE WHEN i > 1 THEN {word.format(c='s[i - 1]')} END, false)"
    wx = f"coalesce(CASE WHEN i < len(s) THEN {word.format(c='s[i + 1]')} END, false)"
    n = f"length({run})"
    l1 = f"length(regexp_extract({run}, '^(-+|[^-]+)'))"
    ln = f"length(regexp_extract({run}, '(-+|[^-]+)$'))"
    g0 = f"({wp} <> (left({run}, 1) <> '-'))"
    ge = f"((right({run}, 1) <> '-') <> {wx})"
    mn = f"(CASE WHEN {g0} THEN 0 WHEN {l1} < {n} THEN {l1} WHEN {ge} THEN {n} END)"
    mx = f"(CASE WHEN {ge} THEN {n} WHEN {l1} < {n} THEN {n} - {ln} WHEN {g0} THEN 0 END)"
    tok = (f"CASE WHEN regexp_full_match({run}, '[a-záéíóúñü0-9-]+') AND {mx} > {mn} "
           f"THEN substr({run}, {mn} + 1, {mx} - {mn}) END")
    return (f"list_filter((SELECT list_transform(range(1, len(s) + 1), lambda i: {tok}) FROM (SELECT {segs} AS s)), "
            f"lambda t: t IS NOT NULL)")


_V = k.with_(k.SONGS_CTE, k.VERSES_CTE)

sql("collapse_ws", _V + f"SELECT song_id, verso_idx, {k.collapse('verso_texto')} AS texto_norm FROM verses")

sql("parse_release_title", _S + """
SELECT song_id,
  trim(regexp_replace(regexp_replace(CASE WHEN strpos(t, ' - ') > 0 THEN substr(t, 1, strpos(t, ' - ') - 1) ELSE t END,
       '\\*', '', 'g'), '\\(\\d+\\)', '', 'g')) AS artista,
  coalesce(string_split(t, ' - ')[2], 'Single/Album') AS album
FROM (SELECT song_id, CASE song_id % 3 WHEN 0 THEN artist WHEN 1 THEN artist || '* (2) - ' || album
                      ELSE artist || ' -  ' || album || '  - Remix - ' || song END AS t FROM songs)""")

sql("min_length_filter", _S + "SELECT song_id, CAST(length(lyrics) AS INTEGER) AS n_chars FROM songs WHERE length(lyrics) >= 150")

_lang_hits = {l: k.hits(k.runs("lyrics"), w) for l, w in LANG_STOPWORDS.items()}
_lang_case = "CASE WHEN greatest({all}) = 0 THEN NULL {whens} END".format(
    all=", ".join(_lang_hits.values()),
    whens=" ".join(f"WHEN {h} = greatest({', '.join(_lang_hits.values())}) THEN {q(l)}" for l, h in _lang_hits.items()))
sql("language_filter", _S + f"SELECT * FROM (SELECT song_id, lang, {_lang_case} AS lang_detectado FROM songs) "
    "WHERE lang_detectado = 'es'")

sql("tokenize", _S + f"""SELECT song_id, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens_txt
FROM (SELECT song_id, {k.word_tokens('lyrics')} AS tk FROM songs)""")

sql("remove_stopwords", _S + f"""SELECT song_id,
  coalesce(array_to_string(list_filter({k.word_tokens('lyrics')}, lambda t: t NOT IN ({k.in_list(STOPWORDS_ES)})), ' '), '')
  AS lyrics_limpias FROM songs""")

sql("coerce_year", _S + f"""SELECT song_id, {k.year_num()} AS year_num, {k.bucket(k.year_num(), 10)} AS decada,
  {k.bucket(k.year_num(), 5)} AS lustro FROM songs""")

sql("year_range_filter", _S + f"""SELECT song_id, CAST({k.year_num()} AS INTEGER) AS year_n FROM songs
WHERE {k.year_num()} BETWEEN 1970 AND 2025""")

sql("coerce_labels", """SELECT doc_id,
  coalesce(CAST(TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE) AS INTEGER), 0) AS es_util_real,
  coalesce(CAST(TRY_CAST(CAST(toxic AS VARCHAR) AS DOUBLE) AS INTEGER), 0) AS toxico FROM labels""")

# review rows derived from labels (sources.reviews)
REVIEW_CTES = [k.SONGS_CTE, k.VERSES_CTE, f"""review_rows AS (
  SELECT v.*, {k.intensities('v.verso_texto', prefix='val_')}, l.quality, l.toxic,
         CASE WHEN v.song_id % 2 = 1 THEN 'K-Means' ELSE 'Regex' END AS origen,
         (['AR','MO','DI','PO','NA','GO'])[CAST(v.song_id % 6 AS INTEGER) + 1] AS dim_archivo,
         CAST(l.quality AS INTEGER) AS es_util_real
  FROM verses v JOIN labels l ON v.song_id = l.doc_id)""", """reviews_union AS (
  SELECT song_id, artist, song, year, verso_idx, verso_texto, origen, {cols} FROM review_rows)""".format(
    cols=", ".join(f"CAST(CASE WHEN dim_archivo = '{d}' THEN val_{d} ELSE 0 END AS INTEGER) AS val_{d}" for d in DIMS)),
    """gold AS (
  SELECT verso_texto, {maxes},
         first(year ORDER BY song_id, verso_idx) FILTER (WHERE year IS NOT NULL) AS year,
         first(artist ORDER BY song_id, verso_idx) FILTER (WHERE artist IS NOT NULL) AS artist
  FROM reviews_union WHERE verso_texto IS NOT NULL GROUP BY verso_texto)""".format(
    maxes=", ".join(f"max(val_{d}) AS val_{d}" for d in DIMS))]
_R = k.with_(*REVIEW_CTES)

_VALS = ", ".join(f"val_{d}" for d in DIMS)
_DOM = "CASE " + " ".join(f"WHEN val_{d} = greatest({_VALS}) THEN '{d}'" for d in DIMS) + " ELSE 'AR' END"
sql("dominant_dimension", _R + f"""SELECT verso_texto, {_DOM} AS dimension_dominante, greatest({_VALS}) AS intensidad_max
FROM gold WHERE greatest({_VALS}) > 0""")

sql("round_clip_labels", _SR + "SELECT song_id, " + ", ".join(
    f"CAST(least(greatest(round_even(intensidad_{d}_avg * 3, 0), 0), 3) AS INTEGER) AS val_{d}" for d in DIMS)
    + " FROM song_rollup WHERE total_estrofas IS NOT NULL")

sql("density_percent", _SR + """SELECT song_id,
  CAST(round_even(densidad_semantica_v2 * CASE WHEN (SELECT max(densidad_semantica_v2) FROM song_rollup) <= 1
       THEN 100.0 ELSE 1.0 END, 0) AS INTEGER) AS densidad_porcentual FROM song_rollup""")

sql("density_category", _SR + f"""SELECT song_id, CASE WHEN coalesce(densidad_semantica_v2, 0) > 0 THEN '{PASS_LABEL}'
  ELSE '{NOISE_LABEL}' END AS categoria FROM song_rollup""")

_FP = "regexp_replace(strip_accents(lower(coalesce(artist, '') || coalesce(song, ''))), '[^a-z0-9]', '', 'g')"
DEDUP_CTE = f"""dedup AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {_FP} ORDER BY song_id) AS rn FROM songs) WHERE rn = 1)"""
_STRONG = k.in_list(STANDIN_STRONG_TERMS)
MARKED_CTE = f"""marked AS (SELECT *, CAST(len(list_filter(list_distinct({_p8_tokens('lyrics')}),
  lambda t: t IN ({_STRONG}))) AS INTEGER) AS conteo_narco FROM dedup)"""
_M = k.with_(k.SONGS_CTE, DEDUP_CTE, MARKED_CTE)

sql("keep_first_dedupe", k.with_(k.SONGS_CTE, DEDUP_CTE) + "SELECT song_id, artist, song FROM dedup")

sql("lexical_mark", _S + f"""SELECT song_id, conteo_narco, conteo_narco >= 2 AS es_narco_fuerte FROM (
  SELECT song_id, CAST(len(list_filter(list_distinct({_p8_tokens('lyrics')}), lambda t: t IN ({_STRONG})))
         AS INTEGER) AS conteo_narco FROM songs)""")

sql("keyword_in_context", _M + f"""SELECT song_id, pos, Artista, Cancion, Palabra,
  '... ' || array_to_string(tk[greatest(pos - 4, 0) + 1: pos + 5], ' ') || ' ...' AS Contexto
FROM (SELECT song_id, artist AS Artista, song AS Cancion, tk, CAST(i - 1 AS INTEGER) AS pos, tk[i] AS Palabra
      FROM (SELECT *, {_p8_tokens('lyrics')} AS tk FROM marked WHERE conteo_narco >= 2),
           LATERAL (SELECT unnest(range(1, len(tk) + 1)) AS i))
WHERE Palabra IN ({_STRONG})""")

sql("rank_by_decade_hits", _M + f"""SELECT song_id, decada, conteo_narco FROM (
  SELECT song_id, conteo_narco, {k.bucket(k.year_num(), 10)} AS decada FROM marked) WHERE decada > 0""")

sql("dimension_regex_filter", _V + " UNION ALL ".join(
    f"SELECT song_id, verso_idx, '{d}' AS dim FROM verses WHERE list_has_any({k.runs('verso_texto')}, "
    f"[{k.in_list(STANDIN_LEXICON[d])}])" for d in DIMS))

sql("vocabulary_intersect", _S + f"""SELECT song_id, array_to_string(list_sort(list_filter(list_distinct(
  {_p8_tokens('lyrics')}), lambda t: t IN ({_STRONG}))), ',') AS terminos FROM songs""")

sql("word_frequency_topn", _S + f"""SELECT term, count(*) AS n FROM (SELECT unnest({k.word_tokens('lyrics')}) AS term FROM songs)
WHERE term NOT IN ({k.in_list(STOPWORDS_ES)}) GROUP BY term ORDER BY n DESC, term LIMIT 100""")

_OV = _R.rstrip() + f""",
ov AS (SELECT origen, unnest({k.word_tokens('verso_texto')}) AS term FROM review_rows)
"""
sql("vocabulary_except", _OV + """SELECT DISTINCT term FROM ov WHERE origen = 'K-Means'
  AND term NOT IN (SELECT term FROM ov WHERE origen = 'Regex')""")

sql("exclusive_terms", _OV + f"""SELECT term, count(*) AS n FROM ov WHERE origen = 'K-Means' AND length(term) > 3
  AND term NOT IN ({k.in_list(STOPWORDS_ES)}) AND term NOT IN (SELECT term FROM ov WHERE origen = 'Regex')
GROUP BY term ORDER BY n DESC, term LIMIT 20""")


def _strip_accents_py(w):
    import unicodedata
    return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")


_NG_STOP = k.in_list({_strip_accents_py(w) for w in STOPWORDS_ES})
sql("ngrams", _S + f"""SELECT ngram, count(*) AS n FROM (
  SELECT unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS ngram
  FROM (SELECT list_filter({k.runs('strip_accents(lower(lyrics))')}, lambda t: t NOT IN ({_NG_STOP})) AS tk FROM songs))
GROUP BY ngram ORDER BY n DESC, ngram LIMIT 100""")

LYR_FIRST_CTE = """lyr AS (SELECT artist, song, arg_min(lyrics, song_id) AS ly FROM songs
  WHERE artist IS NOT NULL AND song IS NOT NULL GROUP BY artist, song)"""
sql("verse_to_stanza", k.with_(k.SONGS_CTE, k.VERSES_CTE, LYR_FIRST_CTE) + f"""
SELECT song_id, verso_idx, coalesce(st[list_filter(range(1, len(st) + 1),
          lambda i: contains({k.collapse('st[i]')}, {k.collapse('verso_texto')}))[1]], verso_texto) AS texto_entrenamiento
FROM (SELECT v.*, {k.stanza_list('l.ly')} AS st FROM verses v LEFT JOIN lyr l USING (artist, song))""")

LYR_LAST_CTE = f"""lyr_t AS (SELECT song, list_filter(list_transform(string_split({k.strip('arg_max(lyrics, song_id)')}, chr(10)),
  lambda l: {k.strip('l')}), lambda l: l <> '') AS lines FROM songs WHERE song IS NOT NULL GROUP BY song)"""
sql("verse_to_window", k.with_(*REVIEW_CTES, LYR_LAST_CTE) + f"""
SELECT song_id, verso_idx,
  CASE WHEN vt = '' OR len(lines) = 0 OR p IS NULL THEN vt
       ELSE array_to_string(lines[greatest(p - 1, 1): p + 1], ' ' || chr(10) || ' ') END AS texto_entrenamiento
FROM (SELECT song_id, verso_idx, vt, lines,
             list_filter(range(1, len(lines) + 1), lambda i: contains(lower(lines[i]), lower(left(vt, 15))))[1] AS p
      FROM (SELECT r.song_id, r.verso_idx, {k.strip('r.verso_texto')} AS vt, coalesce(t.lines, []) AS lines
            FROM reviews_union r LEFT JOIN lyr_t t USING (song)))""")

POOL_CTE = f"""pool AS (SELECT * EXCLUDE (rn) FROM (
  SELECT v.*, d.decada, d.conteo_narco, row_number() OVER (PARTITION BY v.verso_texto
         ORDER BY d.decada, d.conteo_narco DESC, v.song_id, v.verso_idx) AS rn
  FROM verses v JOIN (SELECT song_id, conteo_narco, {k.bucket(k.year_num(), 10)} AS decada FROM marked) d USING (song_id)
  WHERE d.decada > 0 AND d.conteo_narco >= 2) WHERE rn = 1)"""
PMR_CTE = f"""pmr AS (SELECT song_id, artist, song, year, verso_idx, verso_texto FROM pool
  WHERE {k.strip('verso_texto')} NOT IN (SELECT {k.strip('verso_texto')} FROM reviews_union))"""
_P = k.with_(*REVIEW_CTES, DEDUP_CTE, MARKED_CTE, POOL_CTE, PMR_CTE)
sql("pool_minus_reviewed", _P + "SELECT * FROM pmr")

sql("neighbour_context", _P + f"""SELECT song_id, verso_idx, regexp_replace({k.strip("concat_ws(' ', pv, verso_texto, nx)")},
  {q(k.PY_WS + '+')}, ' ', 'g') AS texto_contexto FROM (
  SELECT *, coalesce(lag(verso_texto) OVER w, '') AS pv, coalesce(lead(verso_texto) OVER w, '') AS nx FROM pmr
  WINDOW w AS (PARTITION BY artist, song ORDER BY song_id, verso_idx))""")

_LYR_ANY = "lyr_any AS (SELECT artist, song, arg_min(lyrics, song_id) AS lyrics FROM songs GROUP BY artist, song)"
sql("attach_lyrics_left", k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE, k.DENSITY_CTE, _LYR_ANY) + """
SELECT d.artist, d.song, round(d.densidad_agenciamiento, 6) AS densidad_agenciamiento, l.lyrics
FROM density d LEFT JOIN lyr_any l ON d.artist = l.artist AND d.song = l.song""")

sql("attach_lyrics_inner", k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE, k.DENSITY_CTE, _LYR_ANY) + """
SELECT d.artist, d.song, round(d.densidad_agenciamiento, 6) AS densidad_agenciamiento, l.lyrics
FROM density d JOIN lyr_any l ON d.artist = l.artist AND d.song = l.song
WHERE d.densidad_agenciamiento >= 0.0333 AND l.lyrics IS NOT NULL""")

sql("lookup_last_wins", _R + """SELECT r.song_id, r.verso_idx, r.song, CAST(length(coalesce(t.l, '')) AS INTEGER) AS lyrics_len
FROM reviews_union r LEFT JOIN (SELECT song, arg_max(lyrics, song_id) AS l FROM songs GROUP BY song) t USING (song)""")

TRUTH_CTE = """truth AS (SELECT artist, song, CAST(max(es_util_real) AS INTEGER) AS es_util_real FROM review_rows
  WHERE es_util_real IS NOT NULL AND artist IS NOT NULL AND song IS NOT NULL GROUP BY artist, song)"""
sql("song_truth", k.with_(*REVIEW_CTES, TRUTH_CTE) + "SELECT * FROM truth")

_TJ = k.with_(*REVIEW_CTES, TRUTH_CTE, k.STANZAS_CTE, k.SCORED_STANZAS_CTE, k.ROLLUP_CTE, k.SONG_ROLLUP_CTE) 
TJ_CTE = """tj AS (SELECT t.artist, t.song, t.es_util_real, s.densidad_semantica_v2 FROM truth t
  JOIN song_rollup s ON t.artist = s.artist AND t.song = s.song WHERE s.densidad_semantica_v2 IS NOT NULL)"""
sql("truth_join", _TJ.rstrip() + ",\n" + TJ_CTE + "\nSELECT artist, song, es_util_real, round(densidad_semantica_v2, 6) "
    "AS densidad_semantica_v2 FROM tj")

sql("reviewed_only", _S + """SELECT s.song_id, l.quality AS es_util_real FROM songs s
  LEFT JOIN labels l ON s.song_id = l.doc_id WHERE l.quality IS NOT NULL""")


# ------------------------------------------------------------------------------------------------- batch 3
_AVG = [f"{c}_avg" for c in INTENSITY_COLS]
SERIES_CTE = f"""series AS (SELECT * REPLACE (CAST({k.year_num()} AS INTEGER) AS year) FROM song_rollup
  WHERE densidad_semantica_v2 >= 0.0333 AND {k.year_num()} BETWEEN 1970 AND 2025)"""
_SER = _SR.rstrip() + ",\n" + SERIES_CTE + "\n"


def _entropy_sql(sums: list[str]) -> str:
    tot = "(" + " + ".join(sums) + ")"
    terms = " + ".join(f"(CASE WHEN {x} > 0 THEN ({x} / {tot}) * log2({x} / {tot}) ELSE 0 END)" for x in sums)
    return f"CASE WHEN {tot} > 0 THEN -({terms}) + 0.0 ELSE 0.0 END"


_YCOLS = ["densidad_semantica_v2"] + _AVG
sql("centered_smooth", _SR + f"""SELECT year, {", ".join(f"round(avg({c}) OVER w, 6) AS {c}" for c in _YCOLS)} FROM (
  SELECT CAST({k.year_num()} AS INTEGER) AS year, {", ".join(f"avg({c}) AS {c}" for c in _YCOLS)}
  FROM song_rollup WHERE {k.year_num()} BETWEEN 1970 AND 2025 GROUP BY 1)
WINDOW w AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")

sql("shannon_entropy", _SER + f"""SELECT year, canciones, round({_entropy_sql([f's{i}' for i in range(6)])}, 6) AS entropia
FROM (SELECT year, count(*) AS canciones, {", ".join(f"CAST(sum({c}) AS DOUBLE) AS s{i}" for i, c in enumerate(_AVG))}
      FROM series GROUP BY year)""")

sql("entropy_bootstrap", _SER + f"""
, nby AS (SELECT year, count(*) AS canciones FROM series GROUP BY year HAVING count(*) >= 3)
, rows_ AS (SELECT s.*, row_number() OVER (PARTITION BY s.year ORDER BY s.song_id) - 1 AS idx
            FROM series s JOIN nby USING (year))
, draws AS (SELECT year, canciones, rep, j,
            ('0x' || substr(md5(CAST(year AS VARCHAR) || '|' || CAST(rep AS VARCHAR) || '|' || CAST(j AS VARCHAR)
                                || '|42'), 1, 12))::BIGINT % canciones AS idx
            FROM nby, LATERAL (SELECT unnest(range(0, 100)) AS rep), LATERAL (SELECT unnest(range(0, canciones)) AS j))
, sums AS (SELECT d.year, d.rep, {", ".join(f"CAST(sum(r.{c}) AS DOUBLE) AS s{i}" for i, c in enumerate(_AVG))}
           FROM draws d JOIN rows_ r ON d.year = r.year AND d.idx = r.idx GROUP BY d.year, d.rep)
, ent AS (SELECT year, rep, {_entropy_sql([f's{i}' for i in range(6)])} AS h FROM sums)
SELECT e.year, n.canciones, round(avg(h), 6) AS entropia_media, round(quantile_cont(h, 0.05), 6) AS lim_inferior,
       round(quantile_cont(h, 0.95), 6) AS lim_superior
FROM ent e JOIN nby n USING (year) GROUP BY e.year, n.canciones""")


def _jsd_sql() -> str:
    parts = []
    for i in range(6):
        p, qq = f"p{i}", f"q{i}"
        m = f"(({p} + {qq}) / 2)"
        parts.append(f"(CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0 END)")
        parts.append(f"(CASE WHEN {qq} > 0 THEN {qq} * ln({qq} / {m}) ELSE 0 END)")
    return "(" + " + ".join(parts) + ") / 2"


_dist = ", ".join(f"CASE WHEN tot > 0 THEN s{i} / tot ELSE 1.0 / 6 END AS q{i}" for i in range(6))
sql("js_divergence", _SER + f"""
, per AS (SELECT lustro, {", ".join(f"s{i}" for i in range(6))}, {" + ".join(f"s{i}" for i in range(6))} AS tot FROM (
    SELECT {k.bucket('year', 5)} AS lustro, {", ".join(f"CAST(sum({c}) AS DOUBLE) AS s{i}" for i, c in enumerate(_AVG))}
    FROM series GROUP BY 1))
, dist AS (SELECT lustro, {_dist} FROM per)
, pairs AS (SELECT lustro, lag(lustro) OVER (ORDER BY lustro) AS prev, {", ".join(f"q{i}" for i in range(6))},
                   {", ".join(f"lag(q{i}) OVER (ORDER BY lustro) AS p{i}" for i in range(6))} FROM dist)
SELECT CAST(prev AS VARCHAR) || 's -> ' || CAST(lustro AS VARCHAR) || 's' AS periodo, round({_jsd_sql()}, 6) AS jsd
FROM pairs WHERE prev IS NOT NULL""")

sql("kruskal_wallis", _SR + f"""
, kw AS (SELECT densidad_semantica_v2 AS v, {k.bucket(k.year_num(), 10)} AS g FROM song_rollup
         WHERE {k.year_num()} BETWEEN 1970 AND 2025 AND densidad_semantica_v2 IS NOT NULL)
, rk AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM kw)
, ties AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*) AS t FROM kw GROUP BY v))
, grp AS (SELECT g, count(*) AS ni, sum(r) AS ri FROM rk GROUP BY g)
SELECT CAST(count(*) AS BIGINT) AS grupos, CAST(sum(ni) AS BIGINT) AS n,
       round(CASE WHEN count(*) >= 2 THEN (12.0 / (sum(ni) * (sum(ni) + 1)) * sum(ri * ri / ni) - 3 * (sum(ni) + 1))
             / (1 - max(tie) / (power(sum(ni), 3) - sum(ni))) END, 6) AS h
FROM grp, ties""")

TD = _TJ.rstrip() + ",\n" + TJ_CTE + "\n"
SC_CTE = """, sc AS (SELECT densidad_semantica_v2 AS s, count(*) FILTER (WHERE es_util_real = 1) AS pos,
                count(*) FILTER (WHERE es_util_real <> 1) AS neg FROM tj GROUP BY 1)
, cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                 sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sc)
"""
sql("roc_auc", TD + SC_CTE + """SELECT CAST(sum(pos) AS BIGINT) AS positivos, CAST(sum(neg) AS BIGINT) AS negativos,
  round(sum(neg * (2 * cp - pos)) / (2.0 * sum(pos) * sum(neg)), 6) AS auc FROM cum""")

sql("pr_f1_threshold", TD + SC_CTE + """
, pr AS (SELECT s AS umbral, cp / (cp + cn) AS precision, cp / (SELECT sum(pos) FROM sc) AS recall FROM cum)
SELECT round(umbral, 6) AS umbral, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM pr ORDER BY CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END DESC,
  umbral ASC LIMIT 1""")

sql("classification_report", TD + """
, yp AS (SELECT es_util_real AS y, CAST(densidad_semantica_v2 >= 0.0333 AS INTEGER) AS p FROM tj)
, ks AS (SELECT y AS k FROM yp UNION SELECT p FROM yp)
, per AS (SELECT k, (SELECT count(*) FROM yp WHERE y = k) AS support, (SELECT count(*) FROM yp WHERE p = k) AS npred,
                 (SELECT count(*) FROM yp WHERE y = k AND p = k) AS tp FROM ks)
, m AS (SELECT CAST(k AS VARCHAR) AS clase, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM per)
, m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT clase, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2""")

# samples
_STZ_ALL = k.with_(k.SONGS_CTE, k.STANZAS_CTE, k.SCORED_STANZAS_CTE, k.ROLLUP_CTE, k.SONG_ROLLUP_CTE)
sql("capped_group_sample", _STZ_ALL + """
, pct AS (SELECT song_id, CAST(round_even(densidad_semantica_v2 * CASE WHEN (SELECT max(densidad_semantica_v2)
          FROM song_rollup) <= 1 THEN 100.0 ELSE 1.0 END, 0) AS INTEGER) AS densidad_porcentual FROM song_rollup)
, cand AS (SELECT s.song_id, s.estrofa_no, s.texto_entrenamiento, p.densidad_porcentual FROM stanzas s JOIN pct p USING (song_id)
           WHERE p.densidad_porcentual BETWEEN 1 AND 7)
, dist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id, texto_entrenamiento ORDER BY estrofa_no) AS d
           FROM cand) WHERE d = 1)
, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY estrofa_no) AS r FROM dist) WHERE r <= 2)
SELECT song_id, estrofa_no, texto_entrenamiento, densidad_porcentual FROM (
  SELECT *, row_number() OVER (PARTITION BY densidad_porcentual ORDER BY md5(CAST(song_id AS VARCHAR) || '|42'), song_id, r) AS g
  FROM firsts) WHERE g <= 50""")

sql("one_stanza_per_song", k.with_(k.SONGS_CTE) + f"""
, s2 AS (SELECT * FROM songs WHERE {k.year_num()} BETWEEN 2015 AND 2025)
, stanzas AS (SELECT song_id, CAST(i - 1 AS INTEGER) AS estrofa_no, st[i] AS texto_entrenamiento
  FROM (SELECT *, {k.stanza_list(k.strip('lyrics'))} AS st FROM s2), LATERAL (SELECT unnest(range(1, len(st) + 1)) AS i))
, items AS (SELECT song_id FROM (SELECT DISTINCT song_id FROM stanzas)
            ORDER BY md5(CAST(song_id AS VARCHAR) || '|42'), song_id LIMIT 70)
SELECT song_id, estrofa_no, texto_entrenamiento FROM (
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY md5(CAST(song_id AS VARCHAR) || '|' ||
         CAST(estrofa_no AS VARCHAR) || '|42'), estrofa_no) AS r FROM stanzas WHERE song_id IN (SELECT song_id FROM items))
WHERE r = 1""")

sql("ordered_distinct_units", k.with_(k.SONGS_CTE, k.STANZAS_CTE) + """
SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY estrofa_no) - 1 AS INTEGER) AS pos, texto_entrenamiento
FROM (SELECT *, row_number() OVER (PARTITION BY song_id, texto_entrenamiento ORDER BY estrofa_no) AS d FROM stanzas) WHERE d = 1""")

sql("order_by_year_or_density", _DENS + """SELECT artist, song, year, round(densidad_agenciamiento, 6) AS densidad_agenciamiento
FROM density WHERE densidad_agenciamiento >= 0.08""")

sql("order_by_year", _DENS + """SELECT artist, song, year, total_versos, round(densidad_agenciamiento, 6) AS densidad_agenciamiento
FROM density ORDER BY try_cast(year AS INTEGER) NULLS LAST, artist, song""")

sql("silhouette_euclidean", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN label = other THEN d / nullif(n - 1, 0) END) AS a, max(CASE WHEN label = other THEN n END) AS n,
             min(CASE WHEN label <> other THEN d / n END) AS b FROM s GROUP BY vec_id)
SELECT round(avg(CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silueta FROM p""")

_DM = k.with_(k.SONGS_CTE, k.VERSES_CTE) + ", dm AS (" + " UNION ALL ".join(
    f"SELECT *, '{d}' AS dim FROM verses WHERE list_has_any({k.runs('verso_texto')}, [{k.in_list(STANDIN_LEXICON[d])}])"
    for d in DIMS) + ")\n"
_SAMPLE = _DM + """, samp AS (SELECT dim, song_id, verso_idx, verso_texto FROM (
  SELECT *, row_number() OVER (PARTITION BY dim ORDER BY md5(dim || '|' || CAST(song_id AS VARCHAR) || '|' ||
         CAST(verso_idx AS VARCHAR) || '|42'), dim, song_id, verso_idx) AS r FROM dm) WHERE r <= 100)
"""
sql("seeded_sample", _SAMPLE + "SELECT * FROM samp")
sql("review_sheet", _SAMPLE + "SELECT *, " + ", ".join(f"CAST(NULL AS INTEGER) AS val_{d}" for d in DIMS) + " FROM samp")

sql("union_training", k.with_(*REVIEW_CTES) + f"""
, st2 AS (SELECT st[i] AS t FROM (SELECT s.*, {k.stanza_list(k.strip('s.lyrics'))} AS st FROM songs s
          JOIN labels l ON s.song_id = l.doc_id), LATERAL (SELECT unnest(range(1, len(st) + 1)) AS i))
SELECT verso_texto, {_VALS} FROM gold
UNION ALL SELECT t, CAST(least({k.hits(k.runs('t'), STANDIN_LEXICON['AR'])}, 3) AS INTEGER), 0, 0, 0, 0,
  CAST(least({k.hits(k.runs('t'), STANDIN_LEXICON['GO'])}, 3) AS INTEGER) FROM st2""")

sql("scan_reviews_union", _R + "SELECT * FROM reviews_union")
sql("label_max_pool", _R + "SELECT * FROM gold")
sql("label_merge_by_file_dim", _R + "SELECT artist, song, verso_texto, " + ", ".join(
    f"CAST(coalesce(max(CASE WHEN dim_archivo = '{d}' THEN val_{d} END), 0) AS INTEGER) AS intensidad_{d}" for d in DIMS)
    + " FROM review_rows WHERE artist IS NOT NULL AND song IS NOT NULL AND verso_texto IS NOT NULL GROUP BY ALL")

sql("song_condense", k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE) + """
SELECT artist, song, first(year ORDER BY song_id, verso_idx) FILTER (WHERE year IS NOT NULL) AS year,
  count(verso_texto) AS total_versos, """ + ", ".join(f"max({c}) AS {c}" for c in INTENSITY_COLS)
    + " FROM scored_verses WHERE artist IS NOT NULL AND song IS NOT NULL GROUP BY artist, song")

sql("label_histogram", _R + f"""
, lg AS (SELECT dim, label FROM (UNPIVOT gold ON {_VALS} INTO NAME dim VALUE label) WHERE label IS NOT NULL)
, tot AS (SELECT dim, count(*) AS total, count(*) FILTER (WHERE label > 0) AS activos FROM lg GROUP BY dim)
SELECT p.dim, p.label, p.n, t.total, t.activos, round(t.activos * 100.0 / t.total, 6) AS pct_activos
FROM (SELECT dim, label, count(*) AS n FROM lg GROUP BY ALL) p JOIN tot t USING (dim)""")

sql("origin_decade_counts", _R + f"""SELECT origen, {k.bucket(k.year_num(), 10)} AS decada, count(*) AS n FROM reviews_union
WHERE {k.year_num()} IS NOT NULL GROUP BY ALL""")

sql("top_artists", _R + "SELECT artist, count(*) AS n FROM reviews_union WHERE artist IS NOT NULL GROUP BY artist "
    "ORDER BY n DESC, artist LIMIT 15")

_LC = [f"val_{d}" for d in DIMS]
sql("label_correlation", _R + " UNION ALL ".join(
    f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, round(corr({a}, {b}), 6) AS corr FROM gold"
    for i, a in enumerate(_LC) for b in _LC[i + 1:]))

sql("facet_counts", _R + f"""SELECT {k.bucket(k.year_num(), 10)} AS decada, {_DOM} AS dimension_dominante, count(*) AS n
FROM gold WHERE greatest({_VALS}) > 0 GROUP BY ALL""")

sql("year_kde", _R + f"""
, h AS (SELECT origen, {k.year_num()} AS y, count(*) AS c FROM reviews_union WHERE {k.year_num()} IS NOT NULL GROUP BY ALL)
, st AS (SELECT origen, sum(c) AS n, sum(y * c) / sum(c) AS m, sum(y * y * c) AS ss FROM h GROUP BY origen)
, bw AS (SELECT origen, n, sqrt((ss - n * m * m) / (n - 1)) * pow(n, -0.2) AS bw FROM st)
SELECT h.origen, CAST(x AS INTEGER) AS year,
  round(sum(h.c * exp(-((x - h.y) ^ 2) / (2 * bw.bw * bw.bw))) / (max(bw.n) * max(bw.bw) * sqrt(2 * pi())), 6) AS densidad
FROM h JOIN bw USING (origen), LATERAL (SELECT unnest(range(1970, 2026)) AS x)
WHERE bw.bw > 0 GROUP BY h.origen, x""")

sql("flow_stats", _R + f"""
, dec AS (SELECT CAST(floor(coalesce({k.year_num()}, 2000) / 10) * 10 AS INTEGER) AS d, count(*) AS c FROM gold GROUP BY 1)
, bal AS (SELECT count(*) AS k, max(c) AS c_max, min(c) AS c_min, sum(c) AS tot FROM dec)
SELECT (SELECT count(*) FROM reviews_union WHERE origen = 'Regex') AS regex_in,
       (SELECT count(*) FROM reviews_union WHERE origen = 'K-Means') AS kmeans_in,
       CAST(tot AS BIGINT) AS deduplicado,
       CAST(CASE WHEN least(5, c_min - 1) > 0 THEN k * c_max ELSE tot END AS BIGINT) AS smote_out,
       CAST(CASE WHEN least(5, c_min - 1) > 0 THEN k * c_max ELSE tot END - tot AS BIGINT) AS sinteticos_creados
FROM bal""")


# ------------------------------------------------------------------------------------------------- batch 4
def _bucket(t: str) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % 64)"


sql("encode_units", _V + f"""SELECT song_id, verso_idx, CAST(b AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM (
  SELECT song_id, verso_idx, {_bucket('t')} AS b FROM (SELECT song_id, verso_idx, unnest({k.runs('verso_texto')}) AS t FROM verses))
GROUP BY ALL""")

sql("l2_normalize", """SELECT vec_id, round(nrm, 6) AS norma, round(e[1] / nrm, 6) AS x0, round(list_sum(e) / nrm, 6) AS suma_unitaria
FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")


def _sparse_unit(src: str, keys: str, text: str) -> str:
    """Hash-encoded unit vectors in sparse long form (keys, b, u)."""
    return f"""SELECT {keys}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS u FROM (
  SELECT {keys}, b, count(*) AS c FROM (SELECT {keys}, {_bucket('t')} AS b FROM
    (SELECT {keys}, unnest({k.runs(text)}) AS t FROM {src})) GROUP BY ALL)"""


CENT_CTES = [f"gu AS ({_sparse_unit('gold', 'verso_texto', 'verso_texto')})",
             """anc AS (SELECT verso_texto, substr(dim, 5) AS dim, peso FROM (UNPIVOT gold ON {v} INTO NAME dim VALUE peso)
  WHERE peso > 0)""".format(v=_VALS),
             """cent0 AS (SELECT a.dim, g.b AS pos, sum(a.peso * g.u) / max(t.tw) AS m FROM anc a JOIN gu g USING (verso_texto)
  JOIN (SELECT dim, sum(peso) AS tw FROM anc GROUP BY dim) t USING (dim) GROUP BY a.dim, g.b)""",
             """cent AS (SELECT dim, pos, m / sqrt(sum(m * m) OVER (PARTITION BY dim)) AS v FROM cent0)"""]
_CENT = _R.rstrip() + ",\n" + ",\n".join(CENT_CTES) + "\n"
sql("weighted_centroid", _CENT + "SELECT dim, CAST(pos AS INTEGER) AS pos, round(v, 6) AS valor FROM cent WHERE v <> 0")

_TOPK = k.with_(*REVIEW_CTES, DEDUP_CTE, MARKED_CTE, POOL_CTE, PMR_CTE, *CENT_CTES) + f"""
, pu AS ({_sparse_unit('pmr', 'song_id, verso_idx', 'verso_texto')})
, sims AS (SELECT d.dim, p.song_id, p.verso_idx, round(coalesce(s.sim, 0.0), 9) AS sim
           FROM (SELECT DISTINCT dim FROM cent) d CROSS JOIN (SELECT song_id, verso_idx FROM pmr) p
           LEFT JOIN (SELECT c.dim, u.song_id, u.verso_idx, sum(u.u * c.v) AS sim FROM pu u JOIN cent c ON u.b = c.pos
                      GROUP BY ALL) s ON s.dim = d.dim AND s.song_id = p.song_id AND s.verso_idx = p.verso_idx)
, topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY sim DESC, song_id, verso_idx) AS rank
           FROM sims) WHERE rank <= 1000)
"""
sql("similarity_topk", _TOPK + "SELECT dim, song_id, verso_idx, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similitud_coseno FROM topk")
sql("similarity_band", _TOPK + """SELECT dim, song_id, verso_idx, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similitud_coseno
FROM topk WHERE sim BETWEEN 0.6 AND 0.9""")
sql("score_distribution", _TOPK + """SELECT dim, count(*) AS n, round(quantile_cont(sim, 0.25), 6) AS q1,
  round(quantile_cont(sim, 0.5), 6) AS mediana, round(quantile_cont(sim, 0.75), 6) AS q3 FROM topk GROUP BY dim""")

sql("vector_cache", _V + """, lv AS (SELECT DISTINCT md5(verso_texto || '|hash64') AS clave FROM verses v JOIN labels l ON v.song_id = l.doc_id)
SELECT DISTINCT md5(verso_texto || '|hash64') AS clave,
  md5(verso_texto || '|hash64') IN (SELECT clave FROM lv) AS desde_cache FROM verses""")

_CT = f"""ct AS (SELECT song_id, unnest(list_filter({k.word_tokens('lyrics')}, lambda t: t NOT IN ({k.in_list(STOPWORDS_ES)}))) AS term
  FROM songs)"""
sql("tfidf", k.with_(k.SONGS_CTE, _CT) + """
, tf AS (SELECT song_id, term, count(*) AS tf FROM ct GROUP BY ALL)
, vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 5000)
, nd AS (SELECT count(DISTINCT song_id) AS n FROM ct)
, w AS (SELECT tf.song_id, tf.term, tf.tf * (ln((1.0 + nd.n) / (1.0 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), nd)
SELECT song_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY song_id)), 6) AS weight FROM w""")

sql("knn_within_class", '''
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS vecino, a.label, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, vecino) AS orden FROM p)
SELECT vec_id, vecino, label, round(dist, 6) AS dist, CAST(orden AS INTEGER) AS orden FROM r WHERE orden <= 5''')

sql("stratified_split", _R.rstrip() + f""",
st0 AS (SELECT *, concat_ws('_', {_VALS}) AS e0 FROM gold),
pooled AS (SELECT st0.*, CASE WHEN n0 = 1 THEN 'rare_combination' ELSE e0 END AS estrato
           FROM st0 JOIN (SELECT e0, count(*) AS n0 FROM st0 GROUP BY e0) USING (e0)),
sizes AS (SELECT estrato, count(*) AS n, floor(0.2::DOUBLE * count(*)) AS low, 0.2::DOUBLE * count(*) - floor(0.2::DOUBLE * count(*)) AS rest
          FROM pooled GROUP BY estrato),
quota AS (SELECT estrato, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, estrato)
            <= ceil(0.2::DOUBLE * sum(n) OVER ()) - sum(low) OVER () THEN 1 ELSE 0 END AS k FROM sizes)
SELECT verso_texto, estrato, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split
FROM (SELECT verso_texto, estrato, row_number() OVER (PARTITION BY estrato ORDER BY md5(verso_texto || '|42'), verso_texto) AS r FROM pooled)
JOIN quota USING (estrato)""")

_GL = _R.rstrip() + f""",
gl AS (SELECT verso_texto, substr(dim, 5) AS dim, label FROM (UNPIVOT gold ON {_VALS} INTO NAME dim VALUE label))
"""
sql("balanced_weights", _GL + """, c AS (SELECT dim, label, count(*) AS n_c FROM gl GROUP BY ALL)
SELECT c.dim, c.label, round(t.n / (t.k * c.n_c), 6) AS peso FROM c JOIN (SELECT dim, sum(n_c) AS n, count(*) AS k FROM c GROUP BY dim) t
USING (dim)""")
sql("label_index", _GL + """SELECT dim, label, CAST(row_number() OVER (PARTITION BY dim ORDER BY label) - 1 AS INTEGER) AS indice
FROM (SELECT DISTINCT dim, label FROM gl)""")

_NG2 = k.in_list({_strip_accents_py(w) for w in STOPWORDS_ES})
sql("class_tfidf", _R + f"""
, tg AS (SELECT {_DOM} AS topic, list_filter({k.runs('strip_accents(lower(verso_texto))')}, lambda t: t NOT IN ({_NG2})) AS tk
         FROM gold WHERE greatest({_VALS}) > 0)
, grams AS (SELECT topic, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS ngram FROM tg)
, tf AS (SELECT topic, ngram, count(*) AS tf FROM grams GROUP BY ALL)
, f AS (SELECT ngram, sum(tf) AS f FROM tf GROUP BY ngram)
, a AS (SELECT avg(wt) AS A FROM (SELECT topic, sum(tf) AS wt FROM tf GROUP BY topic))
, sc AS (SELECT tf.topic, tf.ngram, tf.tf * ln(1 + a.A / f.f) AS score FROM tf JOIN f USING (ngram), a)
SELECT topic, ngram, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, ngram) AS rank FROM sc) WHERE rank <= 10""")

sql("topics_over_time", _R + f"""
, tg AS (SELECT {_DOM} AS topic, CAST(least(floor(({k.year_num()} - 1980) / 2.25) + 1, 20) AS INTEGER) AS bin,
                list_filter({k.runs('strip_accents(lower(verso_texto))')}, lambda t: t NOT IN ({_NG2})) AS tk
         FROM gold WHERE {k.year_num()} BETWEEN 1980 AND 2025 AND greatest({_VALS}) > 0)
, grams AS (SELECT topic, bin, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS ngram FROM tg)
, tf AS (SELECT topic, bin, ngram, count(*) AS tf FROM grams GROUP BY ALL)
, f AS (SELECT ngram, sum(tf) AS f FROM tf GROUP BY ngram)
, a AS (SELECT avg(wt) AS A FROM (SELECT topic, bin, sum(tf) AS wt FROM tf GROUP BY topic, bin))
, sc AS (SELECT tf.topic, tf.bin, tf.ngram, tf.tf * ln(1 + a.A / f.f) AS score FROM tf JOIN f USING (ngram), a)
, rk AS (SELECT *, row_number() OVER (PARTITION BY topic, bin ORDER BY score DESC, ngram) AS rank FROM sc)
, tr AS (SELECT topic, bin, string_agg(ngram, ', ' ORDER BY rank) AS terminos FROM rk WHERE rank <= 5 GROUP BY topic, bin)
SELECT d.topic, d.bin, d.n, tr.terminos FROM (SELECT topic, bin, count(*) AS n FROM tg GROUP BY topic, bin) d LEFT JOIN tr USING (topic, bin)""")

_XS = ["intensidad_AR_avg", "intensidad_MO_avg", "intensidad_DI_avg"]
sql("projection_frame", _SR + f"""
, pf AS (SELECT *, {k.year_num()} AS yn FROM song_rollup WHERE {k.year_num()} > 1900 AND total_estrofas IS NOT NULL)
, bd AS (SELECT {", ".join(f"min({c}) - 1 AS {c}_lo, max({c}) + 1 AS {c}_hi" for c in _XS)} FROM pf)
SELECT song_id, CAST(yn AS INTEGER) AS year, CAST({k.bucket('yn', 10)} AS VARCHAR) || 's' AS decada,
  greatest({", ".join(f"{c}_max" for c in INTENSITY_COLS)}) * 3 AS tamano,
  {", ".join(f"round({c}, 6) AS {c}" for c in _XS)},
  {", ".join(f"round({c}_lo, 6) AS {c}_lo, round({c}_hi, 6) AS {c}_hi" for c in _XS)}
FROM pf, bd""")


# ------------------------------------------------------------------------------------------------- streaming
sql("incremental_ingest", k.with_(k.SONGS_CTE) + f"""SELECT song_id, artist, song, year, huella FROM (
  SELECT *, {_FP} AS huella, row_number() OVER (PARTITION BY {_FP} ORDER BY song_id) AS rn FROM songs
  WHERE length(lyrics) >= 150) WHERE rn = 1""")
sql("verse_to_stanza_indexed", ORACLE["verse_to_stanza"])
sql("verse_to_window_indexed", ORACLE["verse_to_window"])
sql("incremental_ingest_stateful", ORACLE["incremental_ingest"])

sql("incremental_rollup", _SR + """SELECT year, count(*) AS canciones, CAST(sum(total_estrofas) AS BIGINT) AS estrofas,
  CAST(sum(estrofas_activas) AS BIGINT) AS activas, round(sum(densidad_semantica_v2) / count(densidad_semantica_v2), 6)
  AS densidad_media FROM song_rollup GROUP BY year""")


# ------------------------------------------------------------------------------------------------ P1, P15, W8
# The driver's texts are NFKC-stable (checked over every document), so the oracle of P1 is the strip alone:
# DuckDB only offers NFC.
sql("normalize_text", _S + f"SELECT song_id, {k.strip('lyrics')} AS lyrics_limpia FROM songs")
sql("unit_active", k.with_(k.SONGS_CTE, k.VERSES_CTE, k.SCORED_VERSES_CTE)
    + f"SELECT song_id, verso_idx, {k.active()} AS verso_es_activo FROM scored_verses")
sql("period_lag", _SER + f"""SELECT lustro, canciones, lag(lustro) OVER (ORDER BY lustro) AS lustro_previo,
  lag(canciones) OVER (ORDER BY lustro) AS canciones_previas
FROM (SELECT {k.bucket('year', 5)} AS lustro, count(*) AS canciones FROM series GROUP BY 1)""")


def _poisson_case() -> str:
    import math
    cdf, acc = [], 0.0
    for i in range(13):
        acc += math.exp(-1.0) / math.factorial(i)
        cdf.append(acc)
    return "CASE " + " ".join(f"WHEN u < {c!r} THEN {i}" for i, c in enumerate(cdf)) + " ELSE 13 END"


sql("entropy_bootstrap_poisson", _SER + f"""
, nby AS (SELECT year, count(*) AS canciones FROM series GROUP BY year HAVING count(*) >= 3)
, reps AS (SELECT s.*, rep, ('0x' || substr(md5(CAST(s.year AS VARCHAR) || '|' || CAST(s.song_id AS VARCHAR) || '|'
                 || CAST(rep AS VARCHAR) || '|42'), 1, 12))::BIGINT / 281474976710656.0 AS u
           FROM series s JOIN nby USING (year), LATERAL (SELECT unnest(range(0, 100)) AS rep))
, w AS (SELECT *, {_poisson_case()} AS wt FROM reps)
, sums AS (SELECT year, rep, {", ".join(f"CAST(sum({c} * wt) AS DOUBLE) AS s{i}" for i, c in enumerate(_AVG))}
           FROM w GROUP BY year, rep)
, ent AS (SELECT year, rep, {_entropy_sql([f's{i}' for i in range(6)])} AS h FROM sums)
SELECT e.year, n.canciones, round(avg(h), 6) AS entropia_media, round(quantile_cont(h, 0.05), 6) AS lim_inferior,
       round(quantile_cont(h, 0.95), 6) AS lim_superior
FROM ent e JOIN nby n USING (year) GROUP BY e.year, n.canciones""")


sql("flow_edges", ORACLE["flow_stats"].rstrip().replace("SELECT (SELECT count(*) FROM reviews_union WHERE origen = 'Regex') AS regex_in",
    ", fs AS (SELECT (SELECT count(*) FROM reviews_union WHERE origen = 'Regex') AS regex_in", 1) + """)
SELECT * FROM (VALUES ('Regex', 'Consolidado'), ('K-Means', 'Consolidado'), ('Consolidado', 'Deduplicado'),
  ('Deduplicado', 'Balanceado'), ('Sintéticos', 'Balanceado')) e(source, target)
  JOIN LATERAL (SELECT CASE WHEN e.source = 'Regex' THEN regex_in WHEN e.source = 'K-Means' THEN kmeans_in
    WHEN e.source = 'Sintéticos' THEN sinteticos_creados ELSE deduplicado END AS value FROM fs) ON true""")

sql("word_frequency_raw", _S + f"""SELECT term, count(*) AS n FROM (SELECT unnest({k.word_tokens('lyrics')}) AS term FROM songs)
GROUP BY term ORDER BY n DESC, term LIMIT 30""")


sql("write_stage", _S + f"SELECT song_id, artist, song, year, {k.bucket(k.year_num(), 10)} AS decada FROM songs")
sql("write_if_absent", _SAMPLE + "SELECT dim, song_id, verso_idx FROM samp")
sql("append_batches", _S + "SELECT song_id, artist, song FROM songs")


sql("facet_margins", _R + f"""SELECT decada, dimension_dominante, count(*) AS n, CAST(GROUPING(decada, dimension_dominante) AS INTEGER) AS nivel
FROM (SELECT {k.bucket(k.year_num(), 10)} AS decada, {_DOM} AS dimension_dominante FROM gold WHERE greatest({_VALS}) > 0)
GROUP BY CUBE (decada, dimension_dominante)""")

sql("neighbour_context_lyric", _V + f"""SELECT song_id, verso_idx, verso_texto,
  regexp_replace({k.strip("concat_ws(' ', pv, verso_texto, nx)")}, {q(k.PY_WS + '+')}, ' ', 'g') AS texto_contexto FROM (
  SELECT *, coalesce(lag(verso_texto) OVER w, '') AS pv, coalesce(lead(verso_texto) OVER w, '') AS nx FROM verses
  WINDOW w AS (PARTITION BY song_id ORDER BY verso_idx))""")


sql("tokenize_alnum_hyphen", _S + f"""SELECT song_id, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, ' ') AS tokens_txt
FROM (SELECT song_id, {_p8_tokens('lyrics')} AS tk FROM songs)""")

# the same results by another way: files written and read back, a Python encoder
for _name, _same in (("scan_songs_csv", "scan_songs"), ("scan_reviews_files", "scan_reviews_union"), ("flow_stats_file", "flow_stats"),
                     ("encode_units_plugged", "encode_units"), ("lexicon_hits_by_table", "lexicon_hits")):
    sql(_name, ORACLE[_same])
