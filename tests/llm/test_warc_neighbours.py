"""WARC round trip and pushdown; quality votes against exact cosines; pipeline against its parts."""

import gzip
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cantoria.llm import neighbours, warc
from tests.llm.conftest import prose
from tests.llm.test_matching import brute_join
from tests.llm.test_text_operators import counts

PAGES = "page_id long, url string, html string, headers string, payload string"


def test_pages_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "short"), (5, "http://a/5", "short"),
            (6, "http://a/6", None), (7, "http://a/7", ""), (8, "u\r\nv", "x" * 200_000), (8, "u", "x" * 200_000), (None, "n", big), (None, None, None)]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], PAGES).repartition(3)
    path = warc.write_pages(pages, str(tmp_path / "archive"))
    got = sorted([tuple(r) for r in warc.page_table(spark, path).collect()], key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = {big: 3, "x" * 200_000: 8}.get(html)
        revisit = first is not None and i != first
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.page_table(spark, warc.write_pages(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_pushed_predicates_skip_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", "y" * 1500 if i % 2 else f"z{i}" * 400, "h", "p") for i in range(30)], PAGES)
    path = warc.write_pages(pages, str(tmp_path / "archive"))
    df = warc.read_warc(spark, path)
    plan = df.filter("warc_type = 'revisit'")._jdf.queryExecution().toString()
    assert df.filter("warc_type = 'revisit'").count() == 14 and "revisit" in plan
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http://h1"), GreaterThan(("offset",), 1)]))
    assert len(left) == 1 and [t[0] for t in reader.tests] == ["warc-type", "warc-target-uri"]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows and all(r["warc_type"] == "response" and r["target_uri"] == "http://h1/" for r in rows)
    assert df.filter(F.col("target_uri").isin("http://h0/", "http://h2/")).count() == 20


def test_foreign_archives(spark, tmp_path):
    records = [warc.make_record([("WARC-Type", "warcinfo"), ("Content-Type", "text/plain")], b"software: test"),
               warc.make_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("Content-Type", "application/http")],
                                b"HTTP/1.1 200 OK\r\nContent-Length: 200000\r\n\r\n" + b"q" * 200_000),
               warc.make_record([("WARC-Type", "resource"), ("WARC-Target-URI", "file:/a")], b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 6 and df.filter("warc_type = 'resource'").count() == 2
    assert [r.n for r in df.filter("warc_type = 'response'").select(F.octet_length("payload").alias("n")).collect()] == [200_000] * 2
    assert warc.read_warc(spark, str(tmp_path), payload=False).filter("payload is not null").count() == 0


# ---------------------------------------------------------------- quality votes

def test_votes_are_exact():
    rnd = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = {"vectors": unit(rnd.standard_normal((500, 8)).astype(np.float32)), "labels": rnd.integers(0, 2, 500).astype(np.float32), "share": 0.3}
    queries = unit(rnd.standard_normal((40, 8)).astype(np.float32))
    got = neighbours.vote(queries, model, k=7, block=64)
    for q, score in zip(queries, got):
        cos = model["vectors"] @ q
        top = np.argsort(-cos)[:7]
        weight = np.maximum(cos[top], 0) ** 8
        assert abs(score - (weight * model["labels"][top]).sum() / weight.sum()) < 1e-4


def junk(i):
    rnd = random.Random(i)
    return " ".join(rnd.choice(["BUY!!", "NOW!!", "###", "$$$ a", "SALE!!"]) for _ in range(80)) if i % 2 else " ".join([rnd.choice(["spam", "ham"])] * 90)


def test_held_out_accuracy(spark):
    rows = [(i, junk(i) if i % 4 == 0 or i % 4 == 3 else prose(i, 100)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 in (1, 2))) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, label int")
    got = neighbours.quality_scores(docs, labels).collect()
    held = [r for r in got if r.doc_id >= 300]
    assert len(got) == 400 and sum((r.score >= 0.7) == (r.doc_id % 4 in (1, 2)) for r in held) >= 97


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1), (10, 0)], "doc_id long, label int")
    rows = neighbours.quality_scores(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in neighbours.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert neighbours.quality_scores(empty, labels).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_keeps_and_drops(spark, tmp_path):
    rows = [(i, prose(i, 90).replace("\n", " the\n"), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)]                       # exact copies
    rows += [(200 + i, rows[i][1].rsplit(" ", 1)[0] + " tail", "en", "s2", 1) for i in range(10)]  # near copies
    rows += [(300, "### " * 80, "en", "s0", 1), (301, None, None, None, None), (302, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = " ".join(rows[20][1].split()[10:50])
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "no such passage in here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            good = {d for d, t, *_ in rows if counts(t)[0] >= 50 and "#" not in t}
            assert ids == good and docs.columns == corpus_pipeline.COLUMNS
        if name == "ngram_jaccard_join":
            want = {v[0] for v in brute_join([(d, t) for d, t, *_ in rows if d in good]).values()}
            assert ids == want == set(range(60))
        if name == "benchmark_decontamination":
            assert ids == set(range(60)) - {20}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(60)) - {20} and all(0 <= r.shard < 24 for r in out)
    words = sum(len(r.text.split()) for r in out)
    whole = sum(counts(rows[i][1])[0] for i in range(60) if i != 20)
    assert abs(words - 1.5 * whole) < 3 * 2 * 250
