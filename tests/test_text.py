"""Edge rows for the scalar text functions and unit builders (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from cantoria.functions import scores as sc
from cantoria.functions import text as tx
from cantoria.operators import units as un


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_py_strip_matches_python(spark):
    samples = ["  a b \t", " x ", "\x1cq\x1f", "", "\n\n", "no-space"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(tx.py_strip("t")).collect()]
    assert got == [s.strip() for s in samples]


def test_tokens_word_and_code(spark):
    text = "él mère r15 ak-47"
    assert one(spark, tx.tokens("t", "word"), text) == ["él", "ak"]
    assert one(spark, tx.tokens("t", "code"), text) == ["él", "r15", "ak-47"]


def test_fingerprint_equal(spark):
    a = one(spark, tx.fingerprint(F.lit("El Jefe*"), F.lit("Niño")), "x")
    b = one(spark, tx.fingerprint(F.lit("el jefe"), F.lit("NINO")), "x")
    assert a == b == "eljefenino"


def test_years(spark):
    df = spark.createDataFrame([("1994",), ("Desconocido",), (None,), ("2026",), ("nan",)], "year string")
    rows = df.select(tx.bucket(tx.year_num("year"), 10).alias("d"),
                     tx.year_num("year").between(1970, 2025).alias("ok")).collect()
    assert [r["d"] for r in rows] == [1990, None, None, 2020, None]
    assert [r["ok"] for r in rows] == [True, None, None, False, None]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.7,), (-0.2,)], "x double")
    assert [r[0] for r in df.select(sc.ordinal("x")).collect()] == [0, 2, 2, 3, 0]


def test_label_coercion(spark):
    df = spark.createDataFrame([("2.0",), ("",), ("x",), (None,), ("3",)], "v string")
    assert [r[0] for r in df.select(tx.label_int("v")).collect()] == [2, 0, 0, 0, 3]


def test_stanzas_blank_lines_and_crlf(spark):
    assert one(spark, un.stanza_array(F.col("t")), "a\nb\n\nc\r\n\r\n\n") == ["a \n b", "c"]


def test_stanzas_long_block(spark):
    nine = "\n".join(f"l{i}" for i in range(9))
    eight = "\n".join(f"l{i}" for i in range(8))
    assert len(one(spark, un.stanza_array(F.col("t")), nine)) == 3
    assert len(one(spark, un.stanza_array(F.col("t")), eight)) == 1


def test_verse_rules(spark):
    lines = ["", "x" * 21, "y" * 20, "z" * 6, "w" * 5]
    text = "\n".join(lines)
    e1 = one(spark, un.verse_array(F.col("t")), text)
    assert [(v["verso_idx"], len(v["verso_texto"])) for v in e1] == [(1, 21)]
    e2 = one(spark, un.dense_verse_array(F.col("t")), text)
    assert [(v["verso_idx"], len(v["verso_texto"])) for v in e2] == [(0, 21), (1, 20), (2, 6)]


def test_dominant_dimension_tie(spark):
    df = spark.createDataFrame([(2, 2, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)],
                               "val_AR int, val_MO int, val_DI int, val_PO int, val_NA int, val_GO int")
    dom, mx = sc.dominant_dimension("val_")
    assert [(r[0], r[1]) for r in df.select(dom, mx).collect()] == [("AR", 2), ("AR", 0)]


def test_density_category_null_is_noise(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.2,), (float("nan"),)], "d double")
    assert [r[0] for r in df.select(sc.density_category("d")).collect()] == ["ruido", "ruido", "aprobada", "ruido"]


def test_parse_release_title(spark):
    a, b = tx.parse_release_title(F.col("t"))
    df = spark.createDataFrame([("Los Tigres* (2) - Jefe de Jefes",), ("Solo Artista",), ("A - B  - C",)], "t string")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("Los Tigres", "Jefe de Jefes"), ("Solo Artista", "Single/Album"), ("A", "B ")]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁn ",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(tx.normalize_text("t")).collect()] == ["fin", "", "plain"]
