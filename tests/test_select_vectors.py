"""Selection, greedy diversity, vector search and balancing."""

import random

import numpy as np
from pyspark.sql import functions as F

from cantoria.operators import select as sel
from cantoria.operators import vectors as vx


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(3, "k", "c"), (1, "k", "a"), (2, "j", "b")], "o long, key string, v string")
    got = sorted(tuple(r) for r in sel.dedupe(df, "key", ["o"]).collect())
    assert got == [(1, "k", "a"), (2, "j", "b")]


def test_quota_sample_equals_greedy_loop(spark):
    random.seed(7)
    rows = []
    for song in range(40):
        for i in range(random.randint(1, 5)):
            rows.append((song % 3, song, i, f"t{random.randint(0, 2)}"))
    df = spark.createDataFrame(rows, "grp int, song long, pos int, txt string")
    got = {(r["grp"], r["song"], r["pos"]) for r in
           sel.quota_sample(df, "grp", "song", "txt", "pos", per_group=7, per_item=2).collect()}
    # greedy reference: songs in hash order, first 2 distinct units each, stop at 7 per group
    order = {r["song"]: r["h"] for r in df.select("song", sel.hash_key("song").alias("h")).distinct().collect()}
    expect = set()
    for g in range(3):
        taken = 0
        for song in sorted({s for gg, s, _, _ in rows if gg == g}, key=lambda s: (order[s], s)):
            seen, picked = set(), []
            for _, s, pos, txt in sorted((r for r in rows if r[1] == song), key=lambda r: r[2]):
                if txt not in seen:
                    seen.add(txt)
                    picked.append(pos)
            for pos in picked[:2]:
                if taken < 7:
                    expect.add((g, song, pos))
                    taken += 1
    assert got == expect


def test_round_robin_rules(spark):
    cands = spark.createDataFrame([
        ("AR", 0, 1, 1970, "ana", "v1", 0.85),
        ("AR", 1, 1, 1970, "bob", "v1", 0.70),   # duplicate verse: first occurrence (attractor 0) wins
        ("AR", 0, 2, 1980, "ana", "v2", 0.80),   # ana already used in 1970 -> skipped
        ("AR", 0, 3, 1980, "cid", "v3", 0.65),
        ("AR", 0, 4, 1990, "dan", "v4", 0.95),   # outside the band
    ], "dim string, attractor int, rank int, decada int, artist string, verso_texto string, similitud_coseno double")
    rows = sel.diverse_round_robin(cands, target=10, keep="first").orderBy("turn").collect()
    assert [(r["decada"], r["artist"], r["verso_texto"]) for r in rows] == [(1970, "ana", "v1"), (1980, "cid", "v3")]
    assert rows[0]["similitud_coseno"] == 0.85


def test_topk_matches_numpy(spark):
    rng = np.random.default_rng(0)
    pool = rng.normal(size=(200, 8))
    pool /= np.linalg.norm(pool, axis=1, keepdims=True)
    att = rng.normal(size=(3, 8))
    att /= np.linalg.norm(att, axis=1, keepdims=True)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pool)], "id long, vec array<double>")
    a = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(att)], "dim string, centroide array<double>")
    got = vx.similarity_topk(p, a, "vec", ["id"], ["dim"], k=5).collect()
    for i in range(3):
        sims = pool @ att[i]
        expect = list(np.argsort(-sims)[:5])
        mine = [r["id"] for r in sorted((r for r in got if r["dim"] == f"d{i}"), key=lambda r: r["rank"])]
        assert mine == expect


def test_weighted_centroid_and_normalize(spark):
    df = spark.createDataFrame([("g", [1.0, 0.0], 1), ("g", [0.0, 1.0], 3)], "g string, v array<double>, w int")
    c = vx.weighted_centroid(df, "g", "v", "w").first()["centroide"]
    expect = np.array([0.25, 0.75]) / np.linalg.norm([0.25, 0.75])
    assert np.allclose(c, expect)
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in z.select(vx.l2_normalize(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_hash_encoder_counts(spark):
    df = spark.createDataFrame([("a a b",)], "t string")
    v = df.select(vx.hash_encode(F.col("t"), dim=16)).first()[0]
    assert sum(v) == 3.0 and max(v) >= 2.0


def test_oversample_skipped_for_singleton_class(spark):
    df = spark.createDataFrame([("a", 1970, [0.0, 1.0], 1), ("b", 1980, [1.0, 0.0], 2), ("c", 1980, [1.0, 1.0], 3)],
                               "id string, dec int, v array<double>, val_AR int")
    nb = spark.createDataFrame([], "id string, vecino string, orden int")
    out = vx.oversample(df, "id", "v", ["val_AR"], "dec", nb)
    assert out.count() == 3 and out.where("sintetico").count() == 0


def test_attach_dedupes_corpus_and_null_safe_mode(spark):
    from cantoria.operators import joins as jn
    corpus = spark.createDataFrame([(1, "a", "s", "first"), (2, "a", "s", "second"), (3, None, "t", "nullkey")],
                                   "song_id long, artist string, song string, lyrics string")
    df = spark.createDataFrame([("a", "s"), (None, "t")], "artist string, song string")
    plain = {(r["artist"], r["song"]): r["lyrics"] for r in jn.attach(df, corpus).collect()}
    assert plain == {("a", "s"): "first", (None, "t"): None}
    compat = {(r["artist"], r["song"]): r["lyrics"] for r in jn.attach(df, corpus, null_safe=True).collect()}
    assert compat == {("a", "s"): "first", (None, "t"): "nullkey"}


def test_rare_combinations_are_pooled_and_split(spark):
    rows = [(f"a{i}", 0, 0) for i in range(10)] + [(f"b{i}", 1, 0) for i in range(2)] + [(f"c{i}", 2, i) for i in range(1, 6)]
    out = sel.stratified_split(spark.createDataFrame(rows, "id string, x int, y int"), ["x", "y"]).collect()
    test = [r["estrato"] for r in out if r["split"] == "test"]
    assert len(out) == 17 and len(test) == 4                      # ceil(0.2 * 17)
    assert sum(r["estrato"] == "rare_combination" for r in out) == 5
    assert sorted(test).count("0_0") == 2 and "rare_combination" in test


def test_units_without_a_song_see_no_neighbours(spark):
    rows = [("a", "s", 1, 0, "u"), ("a", "s", 1, 1, "v"), (None, "s", 2, 0, "x"), (None, "s", 3, 0, "y"), ("a", None, 4, 0, "z")]
    df = spark.createDataFrame(rows, "artist string, song string, song_id long, verso_idx int, verso_texto string")
    got = {r["verso_texto"]: r["texto_contexto"] for r in sel.neighbour_context(df).collect()}
    assert got == {"u": "u v", "v": "u v", "x": "x", "y": "y", "z": "z"}


def test_knn_exact_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, c int, v array<double>")
    got = {}
    for r in vx.knn_exact(df, "id", "v", "c", k=4, block=20).collect():
        got.setdefault(r["id"], {})[r["orden"]] = r["vecino"]
    for i in range(150):
        dist = [(np.linalg.norm(x[i] - x[j]), j) for j in range(i % 2, 150, 2) if j != i]
        assert [got[i][o] for o in (1, 2, 3, 4)] == [j for _, j in sorted(dist)[:4]]


def test_vector_cache_round_trip(spark, tmp_path):
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.withColumn("vec", F.array(F.length("t").cast("double")))

    one = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,)], "t string")
    two = spark.createDataFrame([("bb",), ("ccc",)], "t string")
    first = vx.cached_vectors(one, "t", f"{tmp_path}/c", "e", encode).collect()
    again = vx.cached_vectors(two, "t", f"{tmp_path}/c", "e", encode).collect()
    assert {(r["t"], r["vec"][0], r["desde_cache"]) for r in first} == {("a", 1.0, False), ("bb", 2.0, False)}
    assert {(r["t"], r["vec"][0], r["desde_cache"]) for r in again} == {("bb", 2.0, True), ("ccc", 3.0, False)}
    assert seen == [2, 1]


def test_neighbours_copy_a_row_to_a_bounded_number_of_tasks(spark):
    from cantoria.operators import vectors as vx
    df = spark.range(900).select(F.col("id"), F.lit("a").alias("c"), F.array((F.col("id") % 97).cast("double"), (F.col("id") % 31).cast("double")).alias("v"))
    assert vx.facing(df, "id", "c", block=10).count() <= (vx.KNN_SPREAD + 1) * 900
    v = {r.id: np.array(r.v) for r in df.collect()}
    got = {}
    for r in vx.knn_exact(df, "id", "v", "c", k=3, block=10).collect():
        got.setdefault(r.id, []).append((r.orden, r.vecino))
    for i in (0, 1, 450, 899):
        want = sorted(v, key=lambda j: (j == i, np.sqrt(((v[i] - v[j]) ** 2).sum()), j))[:3]
        assert [j for _, j in sorted(got[i])] == want


def test_neighbours_pass_over_missing_and_unusable_vectors(spark):
    from cantoria.operators import vectors as vx
    rows = [(i, "a", [float(i), 0.0]) for i in range(6)] + [(6, "a", None), (7, "a", [float("nan"), 1.0]), (8, "a", [None, 1.0])]
    got = vx.knn_exact(spark.createDataFrame(rows, "id long, c string, v array<double>"), "id", "v", "c", k=5).collect()
    near = {i: [j for _, j in sorted((r.orden, r.vecino) for r in got if r.id == i)] for i in range(9)}
    assert near[0] == [1, 2, 3, 4, 5] and near[3] == [2, 4, 1, 5, 0] and not near[6] and not near[7] and not near[8]
