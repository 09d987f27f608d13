"""Rollups, thresholds and statistics against hand calculations or brute force."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from cantoria.fixed import STANDIN_LEXICON
from cantoria.operators import rollup as ru
from cantoria.operators import stats as st

DIMS6 = ["a", "b", "c", "d", "e", "f"]


def test_stanza_rollup_inline_matches_grouped(spark):
    songs = spark.createDataFrame(
        [(1, "x", "s1", "1990", "this are\n\nfrom los\nnada"), (2, "x", "s2", "1991", "   "), (3, "y", "s3", None, "which")],
        "song_id long, artist string, song string, year string, lyrics string")
    full = {r["song_id"]: r for r in ru.rollup_back_to_songs(songs, STANDIN_LEXICON).collect()}
    assert full[2]["total_estrofas"] is None and full[2]["densidad_semantica_v2"] is None
    assert full[1]["total_estrofas"] == 2 and full[1]["intensidad_AR_max"] == 2
    assert full[1]["estrofas_activas"] == 2
    assert full[3]["intensidad_PO_max"] == 1


def test_song_density_drops_null_keys_and_first_year(spark):
    songs = spark.createDataFrame(
        [(1, "x", "s", None, "this is a long enough verse line here"), (2, "x", "s", "1980", "plain words without terms at all"),
         (3, None, "s", "1970", "this is a long enough verse line here")],
        "song_id long, artist string, song string, year string, lyrics string")
    rows = ru.song_density_inline(songs, STANDIN_LEXICON).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["year"], r["total_versos"], r["versos_activos"]) == ("1980", 2, 1)


def test_centered_smooth_with_gaps(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([(1970, 1.0), (1971, 2.0), (1975, 6.0)], "year int, v double")
    w = Window.orderBy("year").rowsBetween(-1, 1)
    assert [r[0] for r in df.select(F.avg("v").over(w)).orderBy("year").collect()] == [1.5, 3.0, 4.0]


def test_entropy_zero_total_and_uniform(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = {r["g"]: r["entropia"] for r in st.shannon_entropy(df, "g", ["x", "y"]).collect()}
    assert got[1] == 0.0 and abs(got[2] - 1.0) < 1e-12


def test_jsd_period_gap_and_zero(spark):
    df = spark.createDataFrame([(1970, 1.0, 0.0), (1980, 0.0, 0.0), (1990, 0.0, 1.0)], "p int, x double, y double")
    got = {r["periodo"]: r["jsd"] for r in st.js_divergence(df, "p", ["x", "y"]).collect()}
    assert set(got) == {"1970s -> 1980s", "1980s -> 1990s"}
    # (1,0) vs uniform: JS = 0.5*[1*ln(1/.75)] + 0.5*[.5 ln(.5/.75) + .5 ln(.5/.25)]
    m = [0.75, 0.25]
    expect = 0.5 * (math.log(1 / m[0])) + 0.5 * (0.5 * math.log(0.5 / 0.75) + 0.5 * math.log(0.5 / 0.25))
    assert abs(got["1970s -> 1980s"] - expect / 1) < 1e-9


def test_cumulative_by_value_matches_pandas(spark):
    random.seed(1)
    vals = [(random.randint(0, 300) / 7.0, random.randint(1, 3)) for _ in range(2000)]
    df = spark.createDataFrame(vals, "v double, w long")
    got = {r["v"]: r["cum_w"] for r in st.cumulative_by_value(df, "v", ["w"], n_ranges=8).collect()}
    p = pd.DataFrame(vals, columns=["v", "w"]).groupby("v")["w"].sum().sort_index().cumsum()
    assert got == p.to_dict()
    got_d = {r["v"]: r["cum_w"] for r in st.cumulative_by_value(df, "v", ["w"], descending=True, n_ranges=8).collect()}
    pd_d = pd.DataFrame(vals, columns=["v", "w"]).groupby("v")["w"].sum().sort_index(ascending=False).cumsum()
    assert got_d == pd_d.to_dict()


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y != 1]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_roc_auc_and_best_f1_brute_force(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), random.randint(0, 20) / 20.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = st.roc_auc(df, "y", "s").first()["auc"]
    assert abs(auc - _brute_auc(*zip(*rows))) < 1e-12
    best = st.pr_f1_threshold(df, "y", "s").first()
    P = sum(y for y, _ in rows)
    cands = []
    for t in sorted({s for _, s in rows}):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y != 1)
        p, r = tp / (tp + fp), tp / P
        cands.append((2 * p * r / (p + r) if p + r else 0.0, -t, t))
    f1, _, t = max(cands)
    assert abs(best["f1"] - f1) < 1e-12 and best["umbral"] == t


def test_threshold_tie_goes_low(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.5), (1, 0.8)], "y int, s double")
    # t=0.2: p=2/3, r=1 -> f1=.8 ; t=0.8: p=1, r=.5 -> .667 ; t=.5: p=.5,r=.5
    assert st.pr_f1_threshold(df, "y", "s").first()["umbral"] == 0.2


def test_kruskal_wallis_hand(spark):
    data = [(1.0, "a"), (2.0, "a"), (3.0, "b"), (3.0, "b"), (5.0, "c"), (6.0, "c")]
    df = spark.createDataFrame(data, "v double, g string")
    h = st.kruskal_wallis(df, "v", "g").first()["h"]
    ranks = {1.0: 1, 2.0: 2, 3.0: 3.5, 5.0: 5, 6.0: 6}
    n = 6
    r = {"a": 3, "b": 7, "c": 11}
    hh = 12 / (n * (n + 1)) * sum(v * v / 2 for v in r.values()) - 3 * (n + 1)
    hh /= 1 - (2 ** 3 - 2) / (n ** 3 - n)
    assert abs(h - hh) < 1e-9 and ranks
    assert abs(st.chi2_sf(5.991, 2) - 0.05) < 1e-3 and abs(st.chi2_sf(7.815, 3) - 0.05) < 1e-3


def test_bootstrap_methods_agree_roughly(spark):
    random.seed(5)
    rows = [(2000 + i % 2, i, random.random(), random.random(), random.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "year int, song_id long, x double, y double, z double")
    a = {r["year"]: r for r in st.entropy_bootstrap(df, "year", ["x", "y", "z"], "song_id").collect()}
    b = {r["year"]: r for r in st.entropy_bootstrap(df, "year", ["x", "y", "z"], "song_id", method="poisson").collect()}
    for y in a:
        assert a[y]["lim_inferior"] <= a[y]["entropia_media"] <= a[y]["lim_superior"]
        assert abs(a[y]["entropia_media"] - b[y]["entropia_media"]) < 0.02


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["clase"]: r for r in st.classification_report(df, "y", "p").collect()}
    assert rows["1"]["precision"] == 0.0 and rows["1"]["f1"] == 0.0
    assert abs(rows["accuracy"]["f1"] - 2 / 3) < 1e-12


def test_row_index_dense_per_group(spark):
    random.seed(11)
    rows = [(g, i) for g in range(3) for i in random.sample(range(10_000), 500 + 300 * g)]
    df = spark.createDataFrame(rows, "g int, o long")
    got = {(r["g"], r["o"]): r["_idx"] for r in st.row_index(df, "g", "o", n_ranges=8).collect()}
    for g in range(3):
        ordered = sorted(o for gg, o in rows if gg == g)
        assert [got[(g, o)] for o in ordered] == list(range(len(ordered)))


def test_bootstrap_by_counts_has_the_moments_of_resampling(spark):
    import numpy as np
    from cantoria.operators import stats as st
    rnd = np.random.default_rng(1)
    rows = [(y, int(i), *[float(v) for v in rnd.integers(0, 4, 3)]) for y, n in ((1990, 400), (1991, 7), (1992, 2)) for i in range(n)]
    rows += [(1990, 1000 + i, 3.0, 0.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "year int, song_id int, a double, b double, c double")
    cols = ["a", "b", "c"]
    got = {r.year: r for r in st.entropy_bootstrap_counts(df, "year", cols, reps=400, buckets=8).collect()}
    assert set(got) == {1990, 1991}

    def entropy(s):
        p = s[s > 0] / s.sum()
        return -(p * np.log2(p)).sum()
    for year in got:
        x = np.array([r[2:] for r in rows if r[0] == year])
        sample = np.array([entropy(x[rnd.integers(0, len(x), len(x))].sum(0)) for _ in range(4000)])
        r = got[year]
        assert r.canciones == len(x) and abs(r.entropia_media - sample.mean()) < 5 * sample.std() / 20
        assert abs(r.lim_inferior - np.percentile(sample, 5)) < sample.std() and abs(r.lim_superior - np.percentile(sample, 95)) < sample.std()
    again = st.entropy_bootstrap_counts(df.orderBy("b", "song_id").repartition(7), "year", cols, reps=400, buckets=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))
    assert st.entropy_bootstrap_counts(df.limit(0), "year", cols).count() == 0
