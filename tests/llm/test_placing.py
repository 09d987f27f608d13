"""Mixing and sharding against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cantoria.llm import mixing, sharding


def fill(sizes, weights, budget, cap):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 37), None if i % 23 == 0 else f"s{(i * i) % 7}") for i in range(900)] + [(900, None, "s1"), (None, "w w", "s2")]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"\S+", t or ""))
    want = fill(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.CAP)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)
    again = mixing.mix_plan(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert Counter((r.doc_id, r.copies, r.size) for r in again) == Counter((r.doc_id, r.copies, r.size) for r in got)


def test_mix_edges(edge, empty, spark):
    assert mixing.mix_plan(edge).count() == edge.count()
    assert mixing.mix_plan(empty).count() == 0
    nothing = mixing.mix_plan(spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.copies) for r in nothing] == [(0.0, 0)] * 2


def test_rendezvous_moves_only_into_the_new_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té "), F.col("id")).alias("text"))
    rows = sharding.manifest(docs).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 100 < moved < 230
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        text = f"té {r.doc_id}".encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = sharding.place(docs, weights=[1.0] * 25, grown=None).collect()
    assert {r.doc_id: r.shard for r in grown} == {r.doc_id: r.grown_shard for r in rows}


def test_weights_and_edges(spark, edge, empty):
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    share = Counter(r.shard for r in sharding.place(docs, weights=[1.0, 2.0, 3.0], grown=None).collect())
    assert [abs(share[i] / 6000 - w / 6) < 0.03 for i, w in enumerate((1, 2, 3))] == [True] * 3
    rows = sharding.manifest(edge).collect()
    assert len(rows) == edge.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 5} == {(8, 0)}
    assert len({r.shard for r in rows if r.doc_id == 9}) == 1
    assert sharding.place(edge).columns.count("shard") == 1
    assert sharding.manifest(empty).count() == 0
