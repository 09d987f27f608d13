"""Round 3: steps that read their input once, shuffle no rows by a large group, and keep little in Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantoria.functions.text import _nfkc_arrow
from cantoria.operators import boosting as bo
from cantoria.operators import learn as ml
from cantoria.operators import lexicon as lx
from cantoria.operators import select as sel
from cantoria.operators import stats as st
from cantoria.operators import vectors as vx


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_topic_model_reads_its_input_once(spark):
    rows = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(6)]).alias("vec"))
    found = ml.topic_model(rows, "vec", k=2, min_size=2)
    assert "SIN(" not in optimized(found).upper()          # the vectors are not computed again for the result
    assert found.count() == 60


def test_cluster_features_do_not_tokenise_again(spark):
    rows = spark.createDataFrame([(i, f"a{i % 3} b c{i % 5}") for i in range(30)], "id int, t string")
    found = ml.tfidf_vectors(rows.select("id", F.split("t", " ").alias("tok")), "tok", 100)
    assert "split(" not in optimized(found)
    assert found.columns == ["id", "features"] and found.count() == 30


def test_hash_encode_counts_without_a_filter_per_bucket(spark):
    rows = spark.createDataFrame([("uno dos dos tres " * 40,), ("",), ("...",)], "t string")
    found = rows.select(vx.hash_encode(F.col("t")).alias("v"))
    assert "filter(" not in optimized(found)
    import hashlib
    want = np.zeros(vx.HASH_DIM)
    for w, n in (("uno", 40), ("dos", 80), ("tres", 40)):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % vx.HASH_DIM] += n
    got = [r.v for r in found.collect()]
    assert got[0] == want.tolist() and sum(got[1]) == 0 and sum(got[2]) == 0


def test_encode_with_leaves_other_columns_alone(spark):
    rows = spark.createDataFrame([(2 ** 60 + 1, "a bb"), (None, None)], "id long, t string")    # not a double
    found = vx.encode_with(rows, "t", lambda: lambda ts: np.array([[len(t), 1] for t in ts]), "v", batch_size=1)
    assert {r.id: r.v for r in found.collect()} == {2 ** 60 + 1: [4.0, 1.0], None: [0.0, 1.0]}


def test_binned_trees_give_the_leaves_of_the_cuts():
    random = np.random.default_rng(1)
    x, edges = random.integers(0, 6, (500, 3)).astype(float), np.sort(random.integers(0, 6, (3, bo.BINS - 1)).astype(float), axis=1)
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(3)], axis=1).astype(np.uint8)
    tree = bo._empty(3)
    tree[:, 2] = random.normal(size=len(tree))
    for node in (1, 2, 3, 5, 6):
        f, b = random.integers(3), random.integers(bo.BINS - 1)
        tree[node, :2], tree[node, 4] = (f, edges[f, b]), b
    assert (bo._binned_leaves(bins.ravel(), np.arange(500) * 3, tree) == bo._leaves(x, tree)).all()


def test_packed_rows_come_back_from_slices():
    rows = np.arange(12, dtype=np.int16).reshape(4, 3)
    assert (bo._unpacked(bo._packed(rows).slice(1, 2), np.int16, 3) == rows[1:3]).all()
    assert bo._unpacked(bo._packed(rows).slice(0, 0), np.int16, 3).shape == (0, 3)


def test_stratified_split_joins_strata_by_broadcast(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 190, 0).otherwise(F.col("id") % 3).alias("y"))
    split = sel.stratified_split(rows, ["y"], 0.2)
    assert optimized(split).count("strategy=broadcast") >= 4
    assert split.where("split = 'test'").count() == 40 and split.count() == 200


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lexicon_of_any_size_gives_the_same_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(lx, "BROADCAST_TERMS", limit)
    units = spark.createDataFrame([(1, "sol sol luna"), (1, "sol"), (2, "mar"), (None, "sol"), (3, None)], "id int, verso_texto string")
    words = spark.createDataFrame([("AR", "sol"), ("AR", "sol"), ("MO", "luna"), ("MO", "sol")], "dim string, term string")
    found = lx.score_units_by_table(units, words, ["id"])
    assert ("strategy=broadcast" in optimized(found)) == (limit > 0)
    got = sorted((r.id or 0, r.verso_texto or "", r.intensidad_AR, r.intensidad_MO) for r in found.collect())
    assert got == [(0, "sol", 0, 0), (1, "sol", 3, 3), (1, "sol sol luna", 3, 3), (2, "mar", 0, 0), (3, "", 0, 0)]


def test_nfkc_of_a_batch_changes_only_what_is_not_normal():
    texts = [None, "abc", "ﬁn", "canción", "Ａ" * 3] + ["é"] * 200 + ["é"]
    got = _nfkc_arrow(pa.array(texts)).to_pylist()
    assert got == ["", "abc", "fin", "canción", "AAA"] + ["é"] * 200 + ["é"]


def test_bootstrap_draws_are_made_in_many_tasks(spark, monkeypatch):
    import hashlib
    from collections import Counter
    monkeypatch.setattr(st, "DRAWS", 4)
    sizes = {1990: 9, 1991: 4, 1992: 1}
    rows = spark.createDataFrame([(y, i) for y, n in sizes.items() for i in range(n)], "year int, song_id long")
    n_by = rows.groupBy("year").agg(F.count(F.lit(1)).alias("canciones"))
    draws = st.bootstrap_draws(n_by, "year", 6)
    want = Counter((y, r, j, int(hashlib.md5(f"{y}|{r}|{j}|42".encode()).hexdigest()[:12], 16) % n)
                   for y, n in sizes.items() for r in range(6) for j in range(n))
    assert Counter(tuple(d) for d in draws.select("year", "rep", "_j", "_idx").collect()) == want
    assert draws.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_tfidf_shuffles_no_text_and_merges_repeated_documents(spark):
    texts = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["c", "c", "d"]), (3, []), (4, None), (None, ["a", "e"]), (None, ["a"]), (5, ["a", "z"])]
    rows = spark.createDataFrame(texts, "doc long, term array<string>")
    tf = {}
    for d, words in texts:
        for w in words or []:
            tf[d, w] = tf.get((d, w), 0) + 1
    n = len({d for d, _ in tf})
    cf = {w: sum(v for (_, x), v in tf.items() if x == w) for _, w in tf}
    vocab = sorted(cf, key=lambda w: (-cf[w], w))[:4]
    w = {(d, x): v * (np.log((1 + n) / (1 + sum(1 for _, y in tf if y == x))) + 1) for (d, x), v in tf.items() if x in vocab and d is not None}
    want = {(d, x): v / np.sqrt(sum(u * u for (e, _), u in w.items() if e == d)) for (d, x), v in w.items()}
    for given in (rows, rows.select("doc", F.explode("term").alias("term"))):
        found = ml.tfidf(given, "doc", max_features=4)
        assert found.columns == ["doc", "term", "weight"]
        got = {(r["doc"], r["term"]): r["weight"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    single = ml.tfidf(rows.where("doc in (1, 5)"), "doc", max_features=4)
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()      # weights and norms without a shuffle


def test_nearest_rows_compare_no_ids_pair_by_pair():
    class Id(int):
        asked = 0
        __hash__ = int.__hash__

        def __eq__(self, other):
            Id.asked += 1
            return int(self) == int(other)

    r = np.random.default_rng(3)
    for ids in (list(range(60)), [i % 40 for i in range(60)]):      # unique ids; repeated ids: rows of one id are no neighbours
        v = r.normal(size=(60, 5))
        names = np.array([*map(Id, ids), None], dtype=object)[:-1]
        Id.asked = 0
        best, who = np.full((60, 4), np.inf), np.full((60, 4), None, dtype=object)
        for at in (0, 25):
            vx._nearer(v, names, v[at:at + 25 if at == 0 else None], names[at:at + 25 if at == 0 else None], 4, best, who)
        assert Id.asked < 400                                       # 60 x 60 before
        for i in range(60):
            near = sorted((np.sqrt(((v[j] - v[i]) ** 2).sum()), j) for j in range(60) if ids[j] != ids[i])[:4]
            assert [int(w) for w in who[i]] == [ids[j] for _, j in near] and np.allclose(best[i], [d for d, _ in near])
