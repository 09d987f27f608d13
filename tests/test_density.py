"""Density topics against a plain single-linkage hierarchy on the mutual-reachability matrix."""

import random

import numpy as np
import pytest

from cantoria.operators import density as de

ROWS = "id long, vec array<double>"


def reachability(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, k]                # the row itself is at 0
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    return w, core


def tree(w):
    n, inside, edges = len(w), {0}, []
    while len(inside) < n:
        a, b = min(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: w[e])
        edges.append((w[a, b], a, b))
        inside.add(b)
    return edges


def parts(rows, edges, below):
    up = {r: r for r in rows}

    def find(r):
        while up[r] != r:
            r = up[r]
        return r
    for w, a, b in edges:
        if a in up and b in up and w < below:
            up[find(a)] = find(b)
    out = {}
    for r in rows:
        out.setdefault(find(r), set()).add(r)
    return list(out.values())


def brute(x, min_size, k):
    w, _ = reachability(x, k)
    edges = tree(w)
    strength = lambda v: 1 / max(v, de.LEAST)

    def walk(rows, birth, top):
        """Value and kept clusters of the cluster that is whole just below the distance ``birth``."""
        everyone, stay, worth = set(rows), set(rows), 0.0
        while True:
            inner = [e for e in edges if e[1] in stay and e[2] in stay]
            t = max(e[0] for e in inner)
            pieces = parts(stay, edges, t)
            large = [p for p in pieces if len(p) >= min_size]
            if len(large) == 1:
                worth += (len(stay) - len(large[0])) * (strength(t) - birth)
                stay = large[0]
                continue
            worth += len(stay) * (strength(t) - birth)
            below = [walk(p, strength(t), False) for p in large]
            kept = sum(v for v, _ in below)
            if not top and worth >= kept:
                return worth, [everyone]
            return kept, [c for _, cs in below for c in cs]
    return {frozenset(c) for c in walk(set(range(len(x))), 0.0, True)[1]}


def groups(rows):
    out = {}
    for r in rows:
        if r.topic >= 0:
            out.setdefault(r.topic, set()).add(r.id)
    return {frozenset(v) for v in out.values()}, out


def cloud(seed, sizes, noise, dims=2, copies=0):
    rnd = random.Random(seed)
    x = [[c + rnd.gauss(0, s) for c in centre] for centre, n, s in sizes for _ in range(n)]
    x += [[rnd.uniform(-6, 12) for _ in range(dims)] for _ in range(noise)]
    x += [x[i % 2] for i in range(copies)]
    rnd.shuffle(x)
    return x


@pytest.mark.parametrize("x, min_size, k, block", [
    (cloud(1, [((0, 0), 40, 0.3), ((5, 5), 30, 0.5), ((0, 6), 20, 0.2)], 25), 8, 4, 40),
    (cloud(2, [((0, 0), 25, 1.0), ((1.5, 0), 25, 0.3), ((8, 1), 30, 0.6), ((8, 3), 30, 0.4)], 30, copies=20), 6, 3, 1000),
])
def test_topics_equal_the_plain_hierarchy(spark, x, min_size, k, block):
    df = spark.createDataFrame(list(enumerate(x)), ROWS).repartition(5)
    got = de.density_topics(df, "id", "vec", min_size, k, block).collect()
    assert sorted(r.id for r in got) == list(range(len(x)))
    found, numbered = groups(got)
    assert found == brute(np.array(x), min_size, k) and len(found) >= 2
    order = [(-len(numbered[t]), min(numbered[t])) for t in sorted(numbered)]
    assert order == sorted(order) and sorted(numbered) == list(range(len(numbered)))


def test_tree_is_least(spark):
    x = cloud(5, [((0, 0), 25, 0.3), ((6, 6), 25, 0.3)], 5) + [[3.0, 3.0]] * 40
    pts, near = de.points(spark.createDataFrame(list(enumerate(x)), ROWS), "id", "vec", 4, 20)
    w, core = reachability(np.array(x), 4)
    assert {r.p: r.core for r in pts.collect()} == pytest.approx({i: core[i] for i in range(56)})
    edges = de.spanning_tree(pts, near, 20).collect()
    assert len(edges) == 55 and sum(e.w for e in edges) == pytest.approx(sum(e[0] for e in tree(w)))


def test_edge_tables(spark):
    assert de.density_topics(spark.createDataFrame([], ROWS), "id", "vec").collect() == []
    few = spark.createDataFrame([(1, [0.0]), (2, None), (None, [1.0])], ROWS)
    assert sorted((str(r.id), r.topic) for r in de.density_topics(few, "id", "vec").collect()) == [("1", -1), ("2", -1), ("None", -1)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], ROWS)         # one point, no split: noise
    assert {r.topic for r in de.density_topics(same, "id", "vec").collect()} == {-1}
