"""DuckDB SQL fragments for the oracle, generated from the same constants as the Spark expressions."""

from __future__ import annotations

from cantoria.fixed import DIMS, INTENSITY_COLS, STANDIN_LEXICON
from cantoria.functions.text import STRIP_RE, WORD_CLASS_RE, WORD_RUN_RE, PY_WS
from cantoria.sources.tables import SONGS_SQL

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(terms) -> str:
    return ", ".join(q(t) for t in sorted(set(terms)))


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_RE)}, '', 'g')"


def collapse(x: str) -> str:
    return f"lower(regexp_replace({strip(x)}, {q(PY_WS + '+')}, ' ', 'g'))"


def runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(WORD_RUN_RE)})"


def word_tokens(x: str) -> str:
    return f"list_filter({runs(x)}, lambda t: regexp_full_match(t, {q(WORD_CLASS_RE)}))"


def hits(tok: str, terms) -> str:
    return f"len(list_filter({tok}, lambda t: t IN ({in_list(terms)})))"


def intensities(text: str, lexicon=STANDIN_LEXICON, prefix: str = "intensidad_") -> str:
    tok = runs(text)
    return ", ".join(f"CAST(least({hits(tok, lexicon[d])}, 3) AS INTEGER) AS {prefix}{d}" for d in DIMS)


def active(prefix: str = "intensidad_") -> str:
    return f"CAST(greatest({', '.join(prefix + d for d in DIMS)}) > 0 AS INTEGER)"


def year_num(x: str = "year") -> str:
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


def bucket(x: str, w: int) -> str:
    return f"CAST(floor({x} / {w}) * {w} AS INTEGER)"


SONGS_CTE = f"songs AS ({SONGS_SQL})"

# All lines numbered from 0, stripped, kept when longer than 20
VERSES_CTE = f"""verses AS (
  SELECT song_id, artist, song, year, verso_idx, verso_texto FROM (
    SELECT song_id, artist, song, year, CAST(i - 1 AS INTEGER) AS verso_idx, {strip('ls[i]')} AS verso_texto
    FROM (SELECT *, string_split(lyrics, {NL}) AS ls FROM songs), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))
  WHERE length(verso_texto) > 20)"""

# Stripped lines longer than 5, numbered after the filter
DENSE_CTE = f"""dense AS (
  SELECT song_id, artist, song, year, CAST(i - 1 AS INTEGER) AS verso_idx, ks[i] AS verso_texto
  FROM (SELECT *, list_filter(list_transform(string_split(lyrics, {NL}), lambda l: {strip('l')}),
                               lambda l: length(l) > 5) AS ks FROM songs),
       LATERAL (SELECT unnest(range(1, len(ks) + 1)) AS i))"""


def stanza_list(text: str) -> str:
    """E3 as a DuckDB list expression."""
    blocks = f"string_split(replace({text}, chr(13) || {NL}, {NL}), {NL} || {NL})"
    lines = (f"list_filter(list_transform({blocks}, lambda b: list_filter(list_transform(string_split(b, {NL}), "
             f"lambda l: {strip('l')}), lambda l: l <> '')), lambda ls: len(ls) > 0)")
    cut = ("list_transform({L}, lambda ls: CASE WHEN len(ls) > 8 THEN "
           "list_transform(range(0, CAST(floor((len(ls) - 1) / 4) AS BIGINT) + 1), "
           "lambda i: array_to_string(ls[i * 4 + 1: i * 4 + 4], ' ' || {NL} || ' ')) "
           "ELSE [array_to_string(ls, ' ' || {NL} || ' ')] END)").format(L=lines, NL=NL)
    return f"flatten({cut})"


STANZAS_CTE = f"""stanzas AS (
  SELECT song_id, artist, song, year, CAST(i - 1 AS INTEGER) AS estrofa_no, st[i] AS texto_entrenamiento
  FROM (SELECT *, {stanza_list(strip('lyrics'))} AS st FROM songs), LATERAL (SELECT unnest(range(1, len(st) + 1)) AS i))"""

SCORED_STANZAS_CTE = f"""scored_stanzas AS (SELECT *, {intensities('texto_entrenamiento')} FROM stanzas)"""

ROLLUP_CTE = """rollup AS (
  SELECT song_id, count(*) AS total_estrofas, CAST(sum({act}) AS BIGINT) AS estrofas_activas,
         {maxes}, {avgs}, sum({act}) / count(*) AS densidad_semantica_v2
  FROM scored_stanzas GROUP BY song_id)""".format(
    act=active(),
    maxes=", ".join(f"max({c}) AS {c}_max" for c in INTENSITY_COLS),
    avgs=", ".join(f"avg({c}) AS {c}_avg" for c in INTENSITY_COLS))

SONG_ROLLUP_CTE = """song_rollup AS (
  SELECT s.song_id, s.artist, s.album, s.year, s.song, s.lang, r.* EXCLUDE (song_id)
  FROM songs s LEFT JOIN rollup r ON s.song_id = r.song_id)"""

DENSITY_CTE = """density AS (
  SELECT artist, song, first(year ORDER BY song_id, verso_idx) FILTER (WHERE year IS NOT NULL) AS year,
         count(verso_texto) AS total_versos, CAST(sum({act}) AS BIGINT) AS versos_activos, {maxes},
         sum({act}) / count(verso_texto) AS densidad_agenciamiento
  FROM scored_verses WHERE artist IS NOT NULL AND song IS NOT NULL GROUP BY artist, song)""".format(
    act=active(), maxes=", ".join(f"max({c}) AS {c}" for c in INTENSITY_COLS))

SCORED_VERSES_CTE = f"""scored_verses AS (SELECT *, {intensities('verso_texto')} FROM verses)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
