"""E5 / E6 for long texts: which unit of a song holds a verse, by an index of word heads instead of a scan of the song.

``units.verse_to_stanza`` and ``units.verse_to_window`` put a song's stanzas or lines beside every verse of that song: two
shuffles, and verses x song length bytes of search. That is the better plan for songs; for documents of thousands of lines
the product is what costs. Here a song's units are rows, and each needle is looked up by its rarest word head:

* a text is cut at its spaces; a word's head is its first ``HEAD`` characters. Words of a needle that follow a space are
  words of any unit that holds it; all of them are whole but the last, whose head is known if it is long enough;
* the needle's head that the fewest units of its song hold names the candidates, (song, head) -> unit numbers;
* ``contains`` settles every candidate against that one unit, and the smallest number wins.

A needle with no such word (one word, or two with a short second) has every unit of its song as candidate: only the needle
is repeated for them, and the same join settles it. So nothing is missed and no text is cut.

The index is for the songs that need it: those of more than ``DIRECT`` lines, and those asked by more than ``HOT`` verses.
Every other song has few units, so all of them are candidates and nothing is indexed: verses and unit rows meet in one join
on the song that keeps only the pairs that ``contains`` settles, and the smallest number is taken where they met.

Rows with a null key find nothing, as in an equi-join; equal needles of a song are looked up once in the index; songs without
text and empty tables find nothing. Cost: verses and units are shuffled once each, by the song. For indexed songs one row of
two numbers a word head is shuffled besides, and a unit's text by (song, number). So the work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantoria.fixed import STANZA_JOINER
from cantoria.functions.text import collapse_ws, normalize_text
from cantoria.operators.units import _first_lyrics_per_key, nonblank_lines, stanza_array
from cantoria.session import cut_lineage

HEAD = 4
DIRECT = 64              # lines of a song whose units are all candidates
HOT = 10_000             # verses of a song that meet in one task
BROADCAST_SONGS = 100_000


def _heads(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, HEAD)))


def unit_heads(text: Column) -> Column:
    """The distinct heads of all words of a unit."""
    return _heads(F.split(text, " ", -1))


def needle_heads(words: Column) -> Column:
    """The heads of a needle (its words, cut at spaces) that any text holding the needle must have. Empty words (two
    spaces in a row) are whole words between two spaces and have the empty head."""
    n = F.size(words)
    inner = F.slice(words, 2, F.greatest(n - 2, F.lit(0)))
    last = F.element_at(words, -1)
    known = F.when((n > 1) & (F.length(last) >= HEAD), F.array(last)).otherwise(F.array().cast("array<string>"))
    return _heads(F.concat(inner, known))


def first_holding(needles: DataFrame, units: DataFrame, keys: list[str], searched: Column) -> DataFrame:
    """(keys, _needle, _no): the smallest number of a unit whose ``searched`` text contains the needle.

    ``needles`` has keys and ``_needle``; ``units`` has keys, ``_no`` and what ``searched`` is computed from, one row per
    (keys, _no). Needles must not be null: a filter on them would run their normalisation again."""
    asked = needles.select(*keys, "_needle").distinct().withColumn("_id", F.unhex(F.md5(F.col("_needle").cast("binary"))))
    asked = asked.withColumn("_song", F.xxhash64(*keys))
    asked = asked.withColumn("_words", F.split("_needle", " ", -1)).withColumn("_heads", needle_heads(F.col("_words"))).drop("_words")
    # a song's head is one number: songs or heads of equal numbers only add candidates, which (keys, _no) and the text settle
    index = units.select(*keys, "_no", F.explode(unit_heads(searched)).alias("_head"))
    index = index.select(F.xxhash64(*keys, "_head").alias("_at"), "_no").repartition("_at")
    held = index.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    # needles meet the counts by song and digest, without their text
    heads = asked.select("_song", "_id", *keys, F.explode("_heads").alias("_head")).select("_song", "_id", F.xxhash64(*keys, "_head").alias("_at"))
    rarest = heads.join(held, "_at").groupBy("_song", "_id").agg(F.min(F.struct("_n", "_at"))["_at"].alias("_at"))
    numbers = rarest.join(index, "_at").select("_song", "_id", "_no")
    by_head = asked.join(numbers, ["_song", "_id"]).select(*keys, "_needle", "_no")
    counts = units.groupBy(*keys).agg(F.max("_no").alias("_last"))
    headless = (asked.where(F.size("_heads") == 0).join(counts, keys)
                .select(*keys, "_needle", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_no")))
    settled = by_head.unionByName(headless).join(units.withColumn("_text", searched), [*keys, "_no"])
    return settled.where(F.contains("_text", F.col("_needle"))).groupBy(*keys, "_needle").agg(F.min("_no").alias("_no"))


def first_met(rows: DataFrame, units: DataFrame, keys: list[str], searched: Column) -> DataFrame:
    """Every row with the columns of its song's first unit whose ``searched`` text contains the row's ``_needle`` (null:
    none), by one join on the song; units that come twice give the row twice. Rows without a song are spread."""
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    asked = rows.withColumn("_v", F.monotonically_increasing_id()).withColumn("_at", F.when(known, F.xxhash64(*keys)).otherwise(F.col("_v")))
    given = units.select(F.xxhash64(*keys).alias("_in"), *[F.col(c).alias(f"_u_{c}") for c in keys],
                         *[c for c in units.columns if c not in keys], searched.alias("_text"))
    holds = (F.col("_at") == F.col("_in")) & F.contains("_text", F.col("_needle"))
    for c in keys:
        holds = holds & (F.col(c) == F.col(f"_u_{c}"))
    first = F.rank().over(Window.partitionBy("_at", *keys, "_v").orderBy("_no"))     # where the join has put them
    return asked.join(given, holds, "left").withColumn("_r", first).where(F.col("_r") == 1)


def _look_up(verses: DataFrame, needle, songs: DataFrame, units_of, keys: list[str], searched: Column, out: Column) -> DataFrame:
    """The rows of ``needle(verses)`` with ``out`` of the unit found: by the index for songs of many lines or verses."""
    lines = F.length("lyrics") - F.length(F.replace("lyrics", F.lit("\n"), F.lit("")))
    hot = verses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT)
    many = cut_lineage(songs.where(lines >= DIRECT).select(*keys).unionByName(hot.select(*keys)).dropna().distinct())
    n = many.limit(BROADCAST_SONGS + 1).count()
    if n == 0:
        return first_met(needle(verses), units_of(songs), keys, searched).select(*verses.columns, out)
    given = F.broadcast(many) if n <= BROADCAST_SONGS else many
    few = first_met(needle(verses.join(given, keys, "left_anti")), units_of(songs.join(given, keys, "left_anti")), keys, searched)
    rows = needle(verses.join(given, keys, "left_semi"))
    # spread by (key, number): every later join reads this exchange
    units = units_of(songs.join(given, keys, "left_semi")).repartition(*[F.col(k) for k in keys], F.col("_no"))
    found = first_holding(rows.where(F.col("_needle").isNotNull()), units, keys, searched)
    long = rows.join(found, [*keys, "_needle"], "left").join(units, [*keys, "_no"], "left")
    return few.select(*verses.columns, out).unionByName(long.select(*verses.columns, out))


def verse_to_stanza_indexed(verses: DataFrame, songs: DataFrame, verse_col: str = "verso_texto",
                            keys: tuple[str, ...] = ("artist", "song")) -> DataFrame:
    """E5 with the rows of ``units.verse_to_stanza``: the first stanza of the verse's song that contains it (white space
    collapsed, lower case), else the verse; an empty or null verse gets the first stanza. Adds ``texto_entrenamiento``."""
    keys = list(keys)

    def units_of(songs):
        picked = _first_lyrics_per_key(songs, keys).withColumn("_lyrics", normalize_text("_lyrics"))
        return picked.select(*keys, F.posexplode(stanza_array("_lyrics")).alias("_no", "_unit"))

    def needle(verses):
        return verses.withColumn("_needle", collapse_ws(F.coalesce(normalize_text(verse_col), F.lit(""))))

    return _look_up(verses, needle, songs, units_of, keys, collapse_ws("_unit"),
                    F.coalesce("_unit", F.col(verse_col)).alias("texto_entrenamiento"))


def verse_to_window_indexed(verses: DataFrame, songs: DataFrame, verse_col: str = "verso_texto", prefix_chars: int = 15,
                            radius: int = 1, key: str = "song") -> DataFrame:
    """E6 with the rows of ``units.verse_to_window``: the first line of the title's last song that contains the verse's
    first ``prefix_chars`` characters, with ``radius`` lines on each side; else the verse. Line rows carry their window,
    so a line is written 2 x radius + 2 times."""
    def window(line, i):
        start = F.greatest(i - radius, F.lit(0))
        return F.struct(i.alias("_no"), line.alias("_line"),
                        F.array_join(F.slice("_lines", start + 1, i + radius + 1 - start), STANZA_JOINER).alias("_window"))

    def units_of(songs):
        picked = _first_lyrics_per_key(songs, [key], last=True).withColumn("_lyrics", normalize_text("_lyrics"))
        return picked.select(key, nonblank_lines("_lyrics").alias("_lines")).select(key, F.inline(F.transform("_lines", window)))

    def needle(verses):
        rows = verses.withColumn("_verse", normalize_text(verse_col))
        return rows.withColumn("_needle", F.when(F.col("_verse") != "", F.lower(F.substring("_verse", 1, prefix_chars))))

    return _look_up(verses, needle, songs, units_of, [key], F.lower("_line"), F.coalesce("_window", "_verse").alias("texto_entrenamiento"))
