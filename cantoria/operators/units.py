"""Documents -> units (verses, stanzas, line windows, n-grams).

Units are first built as an **array column inside the document row** (higher-order functions, no Python, no
shuffle). Callers either explode it (unit-level tables) or aggregate it in place (document rollups, see
``rollup.py``), so a corpus is scanned once and never shuffled to go from units back to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.fixed import (DENSE_VERSE_MIN_CHARS, STANZA_JOINER, STANZA_MAX_LINES, STANZA_PIECE_LINES,
                            VERSE_MIN_CHARS)
from cantoria.functions.text import collapse_ws, normalize_text, py_strip

SONG_KEYS = ["song_id", "artist", "song", "year"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ----------------------------------------------------------------------------------------------- array builders
def verse_array(text, min_len: int = VERSE_MIN_CHARS) -> Column:
    """E1 as an array<struct<verso_idx, verso_texto>>: lines split on '\\n', stripped, kept when longer than
    ``min_len``; the index is the position among *all* lines (blank ones count)."""
    lines = F.split(_c(text), "\n", -1)
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("verso_idx"), py_strip(l).alias("verso_texto")))
    return F.filter(numbered, lambda v: F.length(v["verso_texto"]) > min_len)


def dense_verse_array(text, min_len: int = DENSE_VERSE_MIN_CHARS) -> Column:
    """Like E1 but the index is counted after the length filter."""
    kept = F.filter(F.transform(F.split(_c(text), "\n", -1), lambda l: py_strip(l)), lambda l: F.length(l) > min_len)
    return F.transform(kept, lambda l, i: F.struct(i.alias("verso_idx"), l.alias("verso_texto")))


def stanza_array(text, max_lines: int = STANZA_MAX_LINES, piece: int = STANZA_PIECE_LINES,
                 joiner: str = STANZA_JOINER) -> Column:
    """CRLF -> LF, blocks split on a blank line, lines stripped and blank ones dropped, blocks longer than
    ``max_lines`` cut into ``piece``-line pieces, lines joined with ``joiner``."""
    t = F.regexp_replace(_c(text), "\r\n", "\n")
    blocks = F.split(t, "\n\n", -1)
    block_lines = F.transform(
        blocks, lambda b: F.filter(F.transform(F.split(b, "\n", -1), lambda l: py_strip(l)), lambda l: l != ""))
    block_lines = F.filter(block_lines, lambda ls: F.size(ls) > 0)

    def cut(ls):
        starts = F.sequence(F.lit(0), ((F.size(ls) - 1) / piece).cast("int"))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(ls, i * piece + 1, F.lit(piece)), joiner))
        return F.when(F.size(ls) > max_lines, pieces).otherwise(F.array(F.array_join(ls, joiner)))

    return F.flatten(F.transform(block_lines, cut))


def nonblank_lines(text) -> Column:
    """Stripped, non-blank lines."""
    return F.filter(F.transform(F.split(_c(text), "\n", -1), lambda l: py_strip(l)), lambda l: l != "")


# ------------------------------------------------------------------------------------------------- explode ops
def to_verses(songs: DataFrame, min_len: int = VERSE_MIN_CHARS, reindex: bool = False, text_col: str = "lyrics",
              keys: list[str] = SONG_KEYS) -> DataFrame:
    """E1 (``reindex=False``, len > 20) / E2 (``reindex=True``, len > 5): one row per verse."""
    arr = dense_verse_array(text_col, min_len) if reindex else verse_array(text_col, min_len)
    return songs.select(*keys, F.inline(arr))


def to_stanzas(songs: DataFrame, text_col: str = "lyrics", keys: list[str] = SONG_KEYS,
               normalize: bool = True) -> DataFrame:
    """One row per stanza (``estrofa_no`` from 0, ``texto_entrenamiento``); lyrics pass P1 first."""
    text = normalize_text(text_col) if normalize else F.col(text_col)
    return songs.select(*keys, F.posexplode(stanza_array(text)).alias("estrofa_no", "texto_entrenamiento"))


def _first_lyrics_per_key(songs: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One lyric per key (first or last in source order); null keys never match, as in an equi-join."""
    from cantoria.operators.select import dedupe
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0])
    picked = dedupe(songs.where(cond).select(*keys, "song_id", "lyrics"), key, ["song_id"], last=last)
    return picked.select(*keys, F.col("lyrics").alias("_lyrics"))


def verse_to_stanza(verses: DataFrame, songs: DataFrame, verse_col: str = "verso_texto",
                    keys: tuple[str, ...] = ("artist", "song")) -> DataFrame:
    """E5: replace each verse with the first stanza of its song whose collapsed, lower-cased text contains the
    collapsed, lower-cased verse; no match or no song -> the verse itself. An empty verse matches the first
    stanza. Adds ``texto_entrenamiento``.

    Stanzas and their search forms are built once per song (first lyric row per key), then equi-joined to the
    verses: the study's scan of every song per verse becomes a hash join plus a bounded in-row search."""
    lyr = _first_lyrics_per_key(songs, list(keys))
    st = stanza_array(normalize_text("_lyrics"))      # both sides pass P1
    lyr = lyr.select(*keys, st.alias("_st")).select(*keys, "_st", F.transform("_st", lambda x: collapse_ws(x)).alias("_stn"))
    # the needle is computed below the join: a Python UDF (NFKC) cannot run inside a higher-order function, and
    # an expression referenced from inside the per-stanza lambda would be re-evaluated for every stanza
    joined = (verses.withColumn("_needle", collapse_ws(F.coalesce(normalize_text(verse_col), F.lit(""))))
              .join(lyr, list(keys), "left"))
    needle = F.col("_needle")
    idx = F.filter(F.transform("_stn", lambda s, i: F.when(F.contains(s, needle), i)), lambda i: i.isNotNull())
    hit = F.try_element_at(F.col("_st"), F.try_element_at(idx, F.lit(1)) + 1)
    return joined.withColumn("texto_entrenamiento", F.coalesce(hit, F.col(verse_col))).drop("_st", "_stn", "_needle")


def verse_to_window(verses: DataFrame, songs: DataFrame, verse_col: str = "verso_texto", prefix_chars: int = 15,
                    radius: int = 1, key: str = "song") -> DataFrame:
    """The song is looked up by title (last row wins, J5); the first stripped line containing the verse's
    first ``prefix_chars`` characters (case-insensitive) and its ``radius`` neighbours, joined with ' \\n ';
    otherwise (no match, empty verse or empty lyrics) the verse. Lines are built once per title."""
    lyr = _first_lyrics_per_key(songs, [key], last=True)
    lyr = lyr.select(key, nonblank_lines(normalize_text("_lyrics")).alias("_lines"))
    joined = (verses.withColumn("_verse", normalize_text(verse_col))
              .withColumn("_probe", F.lower(F.substring("_verse", 1, prefix_chars)))
              .join(lyr, [key], "left")
              .withColumn("_lines", F.coalesce("_lines", F.array().cast("array<string>"))))
    verse = F.col("_verse")
    probe = F.col("_probe")
    found = F.filter(F.transform("_lines", lambda l, i: F.when(F.contains(F.lower(l), probe), i)),
                     lambda i: i.isNotNull())
    pos = F.try_element_at(found, F.lit(1))
    start = F.greatest(pos - radius, F.lit(0))
    window = F.array_join(F.slice("_lines", start + 1, pos + radius + 1 - start), STANZA_JOINER)
    out = F.when((verse == "") | (F.size("_lines") == 0) | pos.isNull(), verse).otherwise(window)
    return joined.withColumn("texto_entrenamiento", out).drop("_lines", "_verse", "_probe")


def ngram_array(tok: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """Word n-grams (n_min..n_max) of a token array, shorter n first, in text order. Pass a column
    reference (not an expression): the lambdas index it once per n-gram."""
    def grams_of(n: int) -> Column:
        g = F.transform(F.sequence(F.lit(1), F.size(tok) - n + 1), lambda i: F.array_join(F.slice(tok, i, n), " "))
        return F.when(F.size(tok) >= n, g).otherwise(F.array().cast("array<string>"))
    out = None
    for n in range(n_min, n_max + 1):
        out = grams_of(n) if out is None else F.concat(out, grams_of(n))
    return out
