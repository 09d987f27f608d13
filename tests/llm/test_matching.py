"""Similarity join, decontamination and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cantoria.llm import decontaminate, jaccard_join, repeats
from cantoria.llm.components import components
from tests.llm.conftest import prose


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_join(rows):
    """id -> (class, copy_of, links, copies); rows with distinct ids."""
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    texts = list(by)
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    links = [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for i, t in enumerate(texts):
        least[find(i)] = min(least[find(i)], min(by[t]))
    return {d: (least[find(i)], min(by[t]), links[i], len(by[t])) for i, t in enumerate(texts) for d in by[t]}


def mutated(text, rnd, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


def test_join_equals_brute_force(spark):
    rnd = random.Random(7)
    texts = [prose(i, rnd.randint(1, 300)) for i in range(60)]
    texts += [mutated(texts[rnd.randrange(60)], rnd, rnd.randint(0, 6)) for _ in range(120)]
    hub = prose(99, 220)
    texts += [mutated(hub, rnd, rnd.randint(0, 4)) for _ in range(150)] + [texts[3]] * 40 + ["", None, "one", "one", "two words"]
    rows = list(enumerate(texts))
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = brute_join(rows)
    assert {r.doc_id: (r.class_id, r.copy_of, r.n_links, r.n_copies) for r in got} == want


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    hub = prose(98, 200)
    rows = list(enumerate([mutated(hub, rnd, rnd.randint(0, 3)) for _ in range(120)]))
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LEAF_BLOCK", 20)
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.copy_of, r.n_links, r.n_copies) for r in got} == brute_join(rows)


def test_join_edges(edge, empty):
    rows = jaccard_join.similarity_join(edge).collect()
    assert len(rows) == edge.count()
    own = {r.doc_id: r for r in rows}
    assert own[3].class_id == 2 and own[1].class_id == own[1].copy_of == 0 and own[8].copy_of == 7
    kept = jaccard_join.one_of_each(edge)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.columns and sorted(i for i in ids if i is not None) == [0, 2, 4, 6, 7, 9, 10, 11, 12] and ids.count(None) == 2
    assert jaccard_join.similarity_join(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def test_clashing_ids_keep_the_text_that_is_first(spark):
    near = prose(41, 120)
    rows = [(1, near), (5, near + " end"), (5, prose(42, 120)), (6, prose(43, 120)), (6, prose(43, 120) + " end"), (7, prose(42, 120))]
    kept = [tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert rows[0] in kept and rows[2] in kept and rows[1] not in kept and rows[5] not in kept
    assert len(kept) == 3 and sum(i == 6 for i, _ in kept) == 1


def test_intersections():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    got = jaccard_join.intersections(sets)
    for i in range(41):
        for j in range(41):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# ---------------------------------------------------------------- decontamination

def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_scores():
    rnd = np.random.default_rng(2)
    items = [rnd.integers(1, 6, rnd.integers(1, 15)) for _ in range(60)]
    parts = [rnd.integers(1, 6, rnd.integers(1, 30)) for _ in range(60)]
    assert decontaminate.align(items, parts).tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in zip(items, parts)]


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    items = [(i, prose(200 + i, rnd.randint(9, 60)).replace("\n", " ")) for i in range(25)] + [(30, "too short"), (31, None), (32, "")]
    docs = []
    for i in range(120):
        text = prose(500 + i, rnd.randint(0, 150)).replace("\n", " ").split(" ")
        if i % 3 == 0:
            copy = mutated(items[rnd.randrange(25)][1], rnd, rnd.randint(0, 8)).upper().split(" ")
            at = rnd.randint(0, len(text))
            text = text[:at] + [w + rnd.choice(["", ",", "."]) for w in copy] + text[at:]
        docs.append((i, " ".join(text)))
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    clean = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for d, t in docs:
        for k, item in items:
            w = clean(item)
            if len(w) >= 3 and (share := smith_waterman(w, clean(t)) / (2 * len(w))) >= decontaminate.SHARE:
                want[d, k] = round(share, 9)
    assert want and {(r.doc_id, r.item_id): round(r.share, 9) for r in got.collect()} == want


def test_leaks_of_short_items_in_many_documents(spark):
    rnd = random.Random(21)
    clean = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    windows = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    items = [(n, " ".join(f"item{n}x{j}" for j in range(n))) for n in (3, 4, 5, 6, 7, 8, 9, 12, 15)]
    docs = []
    for n, item in items:
        for i in range(45):
            copy = item.split(" ")
            if i % 3 == 1:  # two words stay, one changes, and so on until a window of three is left
                copy = [w if (len(copy) - j) % 3 != 1 or j >= len(copy) - 3 else "changed" for j, w in enumerate(copy)]
                copy = copy if len(copy) > 3 else [*copy, "changed"]
            if i % 3 == 2:
                copy = copy[:3] + [w for c in copy[3:] for w in rnd.choice([["added", c], [c]])][:-1] + ["other"]
            text = prose(900 + i, 40).split() + copy + prose(990 + i, 40).split()
            docs.append((len(docs), " ".join(text)))
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {}
    for d, t in docs:
        for k, item in items:
            w, x = clean(item), clean(t)
            if windows(w) & windows(x) and (share := smith_waterman(w, x) / (2 * len(w))) >= decontaminate.SHARE:
                want[d, k] = round(share, 9)
    assert all(sum(1 for d, k in want if k == n) > 20 for n, _ in items)
    assert {(r.doc_id, r.item_id): round(r.share, 9) for r in got.collect()} == want


def test_partial_and_edited_copies_are_leaks(spark):
    rnd = random.Random(33)
    items = [(n, " ".join(f"item{n}x{j}" for j in range(n))) for n in (16, 39, 59)]
    docs = [(0, f"{prose(1, 50)} {' '.join(items[2][1].split()[:30])} {prose(2, 50)}")]
    for n, item in items:
        for _ in range(8):
            copy = item.split()
            for j in rnd.sample(range(n), n * 3 // 10):
                copy[j] = "changed"
            docs.append((len(docs), f"{prose(700 + len(docs), 50)} {' '.join(copy)} {prose(800 + len(docs), 50)}"))
    docs.append((len(docs), prose(3, 2000)))
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 59), *((1 + 8 * i + j, n) for i, (n, _) in enumerate(items) for j in range(8))}


def test_leaks_are_removed_by_id_and_text(spark):
    item = prose(51, 20).replace("\n", " ")
    rows = [(1, f"{prose(52, 40)} {item}"), (1, prose(53, 40)), (None, f"{prose(54, 40)} {item}"), (None, prose(55, 40)), (2, None)]
    kept = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {tuple(r) for r in kept.collect()} == {rows[1], rows[3], rows[4]}


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, edge.filter("doc_id = 0").first().text), (1, "x y z w v"), (None, None)], "item_id long, text string")
    kept = decontaminate.decontaminate(edge, items)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {None, *range(2, 13)}
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(edge, items.limit(0)).count() == edge.count()


def test_texts_of_one_template_are_not_all_compared(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for t, (shared, own) in enumerate([(100, 100), (120, 100), (140, 60)]):  # Jaccard of about 1/3, 0.37, 0.53
        template = rnd.choices(words, k=shared)
        rows += [(1000 * t + i, " ".join(template + rnd.choices(words, k=own))) for i in range(700)]
    near = rows[5][1].rsplit(" ", 3)[0]
    rows += [(9000 + i, near + f" end{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5).withColumn("rec", F.xxhash64("text"))
    groups = docs.select("rec", F.lit(7).cast("bigint").alias("root"), F.lit(len(rows)).cast("bigint").alias("n")).distinct()
    sizes = [r["count"] for r in jaccard_join.compared(docs, groups, 0.8).groupBy("pair").count().collect()]
    assert sum(sizes) == 61 and max(sizes) == 61
    got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.similarity_join(docs.drop("rec"), "id").collect()}
    assert {i for i, (c, n) in got.items() if n} == {5, *range(9000, 9060)} and all(got[i] == (5, 60) for i in range(9000, 9060))


# ---------------------------------------------------------------- repeated substrings

def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def removed(df):
    out = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return [(r.doc_id, tuple(r)[1:]) for r in out.collect()]


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            a = rnd.randint(0, 300)
            t += rnd.choice(pool)[a:rnd.randint(a, 400)]
            t += "z" * rnd.choice([0, 0, rnd.randint(0, 260)]) + "ab" * rnd.choice([0, 0, rnd.randint(0, 120)])
        rows.append((i, t if i != 7 else None))
    rows += [(100, pool[0][:100]), (101, pool[0][:99]), (102, ""), (103, "q" * 5000)]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert dict(got) == brute_repeats(rows)


def test_documents_without_ids_keep_their_own_bytes(spark):
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rnd.choice(letters) for _ in range(150))
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(120, 400))) + passage for _ in range(1500)]
    out = repeats.remove_repeats(spark.createDataFrame([(None, t) for t in texts] + [(5, texts[0][:130] + passage)], "doc_id long, text string").repartition(6)).collect()
    kept = {bytes(r.kept).decode(): r for r in out if r.doc_id is None}
    whole = [k for k in kept if k in set(texts)]
    assert len(kept) == 1500 and len(whole) == 1 and all(r.n_removed == r.n_bytes - len(k) for k, r in kept.items())
    starts = {t[:110]: t for t in texts}
    for k, r in kept.items():
        if k not in whole:
            assert starts[k[:110]].startswith(k) and 150 <= r.n_removed <= 156 and r.n_spans == 1
    named = [r for r in out if r.doc_id == 5]
    assert len(named) == 1 and named[0].n_removed == 280 and bytes(named[0].kept) == b""


def test_hot_anchors_are_compared_string_by_string(spark, monkeypatch):
    rnd = random.Random(12)
    common = "".join(rnd.choice("abcdefgh ") for _ in range(230))
    rows = [(i, "".join(rnd.choice("klmno") for _ in range(rnd.randint(0, 60))) + common[rnd.randint(0, 40):200 + rnd.randint(0, 30)]
             + "".join(rnd.choice("pqrst") for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    assert dict(removed(df)) == want
    monkeypatch.setattr(repeats, "HOT", 5)
    assert dict(removed(df)) == want


def test_repeats_edges(spark, edge, empty):
    got = removed(edge)
    assert len(got) == edge.count() and removed(empty) == []
    own = defaultdict(list)
    for d, r in got:
        own[d].append(r)
    assert own[8][0][1] == own[8][0][0] > 100_000 and own[9][0] == own[9][1] and own[5] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    twice = [(1, "t" * 50 + prose(3, 60))] * 2
    assert [r[1] for _, r in removed(spark.createDataFrame(twice, "doc_id long, text string"))] == [0, 0]


def test_transform_equals_string_sets():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 4, (3, repeats.COLUMNS)).astype(np.uint16)
    symbols = base[rnd.integers(0, 3, 60)].copy()
    for r in symbols:
        r[rnd.integers(0, repeats.COLUMNS, 2)] = rnd.integers(0, 4, 2)
        r[:rnd.integers(0, 40)] = 256
    rank = rnd.permutation(60)
    got = repeats.covered_strings(symbols, rank)
    for c in range(repeats.SPAN):
        strings = [r[c:c + repeats.LENGTH].tobytes() for r in symbols]
        for i in range(60):
            assert got[i, c] == any(strings[j] == strings[i] and rank[j] < rank[i] for j in range(60))
