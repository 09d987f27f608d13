"""Round 4: rows are scored once, neighbours travel without their texts, density topics leave far rows alone."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantoria.operators import boosting as bo
from cantoria.operators import vectors as vx
from cantoria.plans import catalog
from cantoria.plans.catalog import QUERIES, reset_stages

WORDS = ["this are sus", "from con avec", "were por pour", "which los les", "have una une", "not del des"]


@pytest.fixture(scope="module")
def labelled(spark):
    """A folder with documents and labels of twelve songs."""
    d = tempfile.mkdtemp(prefix="cantoria-r04-")
    text = "\n".join(f"{w} and a verse of line {i}" for i, w in enumerate(WORDS * 3))
    spark.createDataFrame([(i, f"{text}\n{WORDS[i % 6]} closes song {i}", "es", f"src{i}", 1) for i in range(12)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    reset_stages()
    return d


def test_reports_read_scores_that_were_made_once(spark, labelled, monkeypatch):
    seen, score = spark.sparkContext.accumulator(0), bo.score

    def counted(df, *args):
        out = score(df, *args)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return out.mapInArrow(run, out.schema)
    monkeypatch.setattr(bo, "score", counted)
    monkeypatch.setattr(catalog, "BOOSTING", {"rounds": 1, "step": 0.3, "patience": 5})
    reset_stages()
    rows = QUERIES["train_multilabel_boosted"](spark, labelled).collect()
    assert len(rows) == 6 and {r.filas for r in rows} == {seen.value}


def test_a_vector_from_a_python_encoder_is_normalised(spark):
    rows = spark.createDataFrame([("uno dos dos",), ("",), (None,)], "t string")
    got = [r.v for r in rows.select(vx.l2_normalize(vx.hash_encode(F.col("t"))).alias("v")).collect()]
    assert sum(v * v for v in got[0]) == pytest.approx(1.0) and set(got[1]) == {0.0} and set(got[2]) == {None}


def test_drawn_neighbours_by_number_give_the_rows_of_a_search_by_text(spark):
    random = np.random.default_rng(5)
    rows = [(f"t{random.integers(10 ** 9):09d}{i}", int(random.choice([1970, 1980, 1990], p=[0.6, 0.3, 0.1])), random.integers(0, 3, 4).astype(float).tolist(), int(i % 4))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id string, dec int, v array<double>, val_AR int").repartition(4)
    every = vx.knn_exact(df, "id", "v", "dec", k=5, block=40)
    by_text = vx.oversample(df, "id", "v", ["val_AR"], "dec", every)
    g = vx.numbered(df, "id", "n").localCheckpoint()
    assert [r.id for r in g.orderBy("n").collect()] == sorted(r[0] for r in rows)
    drawn = vx.draws(g, "id", "dec", key="n")
    some = vx.knn_exact(g, "n", "v", "dec", k=5, block=40, asked=drawn)
    assert {r.n for r in some.collect()} == {r.n for r in drawn.collect()}
    by_number = vx.oversample(g, "id", "v", ["val_AR"], "dec", some, key="n", drawn=drawn)
    plain = lambda d: sorted((r.id, r.dec, tuple(r.v), r.val_AR, r.sintetico) for r in d.collect())
    assert plain(by_number) == plain(by_text) and by_number.where("sintetico").count() > 100


def test_gold_rows_are_not_kept_as_a_checkpoint(spark, labelled):
    import os
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) if "rdd-" in d for f in fs)
    reset_stages()
    before = size()
    QUERIES["flow_stats"](spark, labelled).collect()
    assert size() == before


def test_terms_meet_their_totals_without_a_join(spark):
    from cantoria.operators import learn as ml
    grams = spark.createDataFrame([(t, w) for t, ws in ((0, "a a b c"), (1, "a b b d"), (None, "d d")) for w in ws.split()] + [(1, None)], "topic int, ngram string")
    found = ml.class_tfidf(grams, "topic", top=2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.topic, r["rank"]): (r.ngram, round(r.score, 9)) for r in found.collect()}
    tf, f, words = {(0, "a"): 2, (0, "b"): 1, (0, "c"): 1, (1, "a"): 1, (1, "b"): 2, (1, "d"): 1, (None, "d"): 2}, {"a": 3, "b": 3, "c": 1, "d": 3}, (4 + 5 + 2) / 3
    for t in (0, 1, None):
        best = sorted((-n * np.log(1 + words / f[w]), w) for (k, w), n in tf.items() if k == t)[:2]
        assert [got[t, i + 1] for i in range(len(best))] == [(w, round(-s, 9)) for s, w in best]


def test_one_task_keeps_the_topics_of_the_rounds(spark, monkeypatch):
    from cantoria.operators import density as de
    random = np.random.default_rng(8)
    x = np.concatenate([random.normal(c, s, (n, 3)) for c, n, s in ((0, 20, 0.3), (6, 16, 0.4))] + [random.uniform(-3, 12, (6, 3))]).round(2)
    far = 2 ** 60                                                   # ids that no float holds
    df = spark.createDataFrame([(far + i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    pts, near = de.points(df, "id", "vec", 4, 8)
    assert pts.select("cell").distinct().count() > 4
    tree = de.spanning_tree(pts, near, 64)
    of = lambda d: {frozenset(r.p for r in g) for g in groups(d)}

    def groups(d):
        out = {}
        for r in d.collect():
            out.setdefault(r.cluster, []).append(r)
        return out.values()
    walked = of(de._kept(pts, tree, 6))
    monkeypatch.setattr(de, "ONE_TASK", -1)
    assert walked == of(de._kept(pts, tree, 6)) and len(walked) >= 2


def test_far_cells_are_not_compared(spark, monkeypatch):
    """Groups that lie far apart: a point meets few of the others, and the lists are those of all pairs."""
    from cantoria.operators import density as de
    random = np.random.default_rng(2)
    x = np.concatenate([random.normal(20 * c, 0.5, (50, 2)) for c in range(8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    pairs, distances = spark.sparkContext.accumulator(0), de._distances

    def counted(a, b):
        pairs.add(len(a) * len(b))
        return distances(a, b)
    monkeypatch.setattr(de, "_distances", counted)
    pts, near = de.points(df, "id", "vec", 4, 50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert {(r.p, r.q) for r in near.collect()} == {(i, int(j)) for i in range(400) for j in np.argsort(d[i], kind="stable")[:de.LISTED]}
    assert 0 < pairs.value < 400 * 400 // 2
