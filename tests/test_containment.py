"""E5 / E6 by the index of word heads equal the in-row scan."""

import random

import pytest
from pyspark.sql import functions as F

from cantoria.operators import containment as ct
from cantoria.operators import units as un

SONG = "song_id long, artist string, song string, year string, lyrics string"
VERSE = "song_id long, artist string, song string, n int, verso_texto string"


def _corpus(spark, seed=3):
    """Songs of few, short words in a small alphabet (many shared heads and parts of words), and needles cut anywhere."""
    rng = random.Random(seed)
    songs, verses = [], []
    for i in range(40):
        blocks = ["\n".join(" ".join("".join(rng.choice("abÑ") for _ in range(rng.randint(1, 6)))
                                     for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 5)))
                  for _ in range(rng.randint(1, 6))]
        text = "\n\n".join(blocks)
        songs.append((i, f"a{i % 7}", f"s{i % 11}", "2001", text))
        for n in range(12):
            start = rng.randrange(len(text))
            verses.append((i, f"a{i % 7}", f"s{i % 11}", n, text[start:start + rng.randint(0, 30)]))
        verses.append((i, f"a{i % 7}", f"s{i % 11}", 90, "zz nowhere zz"))
        verses.append((i, f"a{i % 7}", f"s{i % 11}", 91, ""))
        verses.append((i, f"a{i % 7}", f"s{i % 11}", 92, None))
    songs += [(100, "a1", None, "2001", "aa bb\n\ncc"), (101, "z", "z", "2001", None), (102, "y", "y", "2001", "")]
    verses += [(100, "a1", None, 0, "aa bb"), (101, "z", "z", 0, "aa"), (102, "y", "y", 0, "aa"), (103, "q", "q", 0, "aa")]
    verses += verses[:5]
    return spark.createDataFrame(songs, SONG), spark.createDataFrame(verses, VERSE)


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stanza_index_equals_the_scan(spark):
    songs, verses = _corpus(spark)
    want = _rows(un.verse_to_stanza(verses, songs).select("song_id", "n", "verso_texto", "texto_entrenamiento"))
    got = _rows(ct.verse_to_stanza_indexed(verses, songs).select("song_id", "n", "verso_texto", "texto_entrenamiento"))
    assert got == want and len(got) == verses.count()


def test_window_index_equals_the_scan(spark):
    songs, verses = _corpus(spark, 5)
    for chars, radius in ((15, 1), (4, 2)):
        want = un.verse_to_window(verses, songs, prefix_chars=chars, radius=radius)
        got = ct.verse_to_window_indexed(verses, songs, prefix_chars=chars, radius=radius)
        cols = ["song_id", "n", "verso_texto", "texto_entrenamiento"]
        assert _rows(got.select(cols)) == _rows(want.select(cols))


def test_needle_heads_are_heads_of_every_holder(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice("abc ñ") for _ in range(rng.randint(0, 60)))
        start = rng.randint(0, len(text))
        rows.append((text, text[start:start + rng.randint(0, 30)]))
    d = spark.createDataFrame(rows, "t string, n string").withColumn("w", F.split("n", " ", -1))
    bad = d.where(F.size(F.array_except(ct.needle_heads(F.col("w")), ct.unit_heads(F.col("t")))) > 0)
    assert bad.count() == 0


def test_empty_tables_and_one_hot_song(spark):
    songs, verses = _corpus(spark)
    assert ct.verse_to_stanza_indexed(verses.limit(0), songs).count() == 0
    assert _rows(ct.verse_to_stanza_indexed(verses, songs.limit(0)).select("texto_entrenamiento")) == _rows(verses.select("verso_texto"))
    lines = [f"line number {i} of the same long text" for i in range(3000)]
    hot = spark.createDataFrame([(1, "h", "h", "2001", "\n\n".join(lines))], SONG)
    asked = spark.createDataFrame([(1, "h", "h", i, f"number {i} of the") for i in range(3000)], VERSE)
    out = ct.verse_to_stanza_indexed(asked, hot)
    assert out.where(F.col("texto_entrenamiento") != F.concat(F.lit("line number "), F.col("n"), F.lit(" of the same long text"))).count() == 0


def test_no_array_of_units_beside_a_verse(spark):
    songs, verses = _corpus(spark)
    plan = ct.verse_to_stanza_indexed(verses, songs)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "try_element_at" not in plan


@pytest.mark.parametrize("direct,hot,broadcast", [(0, 10_000, 100_000), (0, 10_000, 0), (9, 20, 100_000), (10 ** 6, 10 ** 6, 0)])
def test_indexed_and_direct_songs_equal_the_scan(spark, monkeypatch, direct, hot, broadcast):
    for name, v in (("DIRECT", direct), ("HOT", hot), ("BROADCAST_SONGS", broadcast)):
        monkeypatch.setattr(ct, name, v)
    songs, verses = _corpus(spark, 7)
    cols = ["song_id", "n", "verso_texto", "texto_entrenamiento"]
    verses = verses.unionByName(spark.createDataFrame([(200, None, None, i, t) for i, t in enumerate(["aa", "", None])], VERSE))
    assert _rows(ct.verse_to_stanza_indexed(verses, songs).select(cols)) == _rows(un.verse_to_stanza(verses, songs).select(cols))
    assert _rows(ct.verse_to_window_indexed(verses, songs).select(cols)) == _rows(un.verse_to_window(verses, songs).select(cols))


def test_short_songs_shuffle_no_word_heads(spark):
    songs, verses = _corpus(spark)
    plan = ct.verse_to_stanza_indexed(verses, songs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_head" not in plan and plan.count("Join LeftOuter") == 1


@pytest.mark.parametrize("direct", [0, 64])
def test_a_song_that_comes_twice_gives_its_verses_twice(spark, monkeypatch, direct):
    monkeypatch.setattr(ct, "DIRECT", direct)
    songs = spark.createDataFrame([(1, "a", "s", "2001", "uno dos\n\ntres")] * 2, SONG)
    verses = spark.createDataFrame([(1, "a", "s", 0, "tres"), (1, "a", "s", 1, "nada"), (1, "b", "s", 2, "uno")], VERSE)
    got = _rows(ct.verse_to_stanza_indexed(verses, songs).select("n", "texto_entrenamiento"))
    assert got == _rows(spark.createDataFrame([(0, "tres"), (0, "tres"), (1, "nada"), (2, "uno")], "n int, t string"))
