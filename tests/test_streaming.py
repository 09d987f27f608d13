"""R1 replay safety and cross-batch dedupe."""

import tempfile

from cantoria.streaming.ingest import _ingest_batch


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_ingest_replay_and_cross_batch_dedupe(spark):
    target = tempfile.mkdtemp(prefix="cantoria-ingest-") + "/t"
    long_text = "x" * 200
    run = _ingest_batch(target, 150)
    b0 = docs(spark, [(1, long_text, "es", "src1", 200), (2, "short", "es", "src2", 5)])
    run(b0, 0)
    run(b0, 0)                       # replay of batch 0 replaces its own partition
    assert spark.read.parquet(target).count() == 1
    # doc 181 is the planted duplicate of doc 161 (same title, upper-cased artist): same fingerprint
    b1 = docs(spark, [(161, long_text, "es", "src1", 200), (181, long_text, "es", "src1", 200), (1, long_text, "es", "src1", 200)])
    run(b1, 1)
    got = sorted(r["song_id"] for r in spark.read.parquet(target).collect())
    assert got == [1, 161]


def test_restart_keeps_earlier_batches(spark):
    from cantoria.streaming.ingest import ingest_stream, run_to_completion
    base = tempfile.mkdtemp(prefix="cantoria-restart-")
    rows = [(i, f"{i} " * 100, "es", f"src{i}", 1) for i in range(1, 6)]
    for name, part in (("a", rows[:3]), ("b", rows[3:])):
        docs(spark, part).write.parquet(f"{base}/in/documents-{name}.parquet")
        _, q = ingest_stream(spark, f"{base}/in/*", target=f"{base}/t", glob="*.parquet")
        run_to_completion(q)
    assert sorted(r["song_id"] for r in spark.read.parquet(f"{base}/t").collect()) == [1, 2, 3, 4, 5]
    _, q = ingest_stream(spark, f"{base}/in/*", target=f"{base}/t", glob="*.parquet", checkpoint=f"{base}/other")
    run_to_completion(q)
    assert spark.read.parquet(f"{base}/t").count() == 5


def test_unreadable_target_is_an_error(spark):
    import pytest
    target = tempfile.mkdtemp(prefix="cantoria-bad-")
    with open(f"{target}/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        _ingest_batch(target, 150)(docs(spark, [(1, "x" * 200, "es", "s", 1)]), 0)


def test_stateful_ingest_remembers_across_restarts_and_costs_its_own_rows(spark):
    from cantoria.streaming.ingest import ingest_stateful, run_to_completion
    base = tempfile.mkdtemp(prefix="cantoria-state-")
    long_text = "x" * 200
    # doc 181 is the planted duplicate of doc 161: same fingerprint
    parts = {"a": [(181, long_text, "es", "src1", 1), (161, long_text, "es", "src1", 1)] + [(i, f"{i} " * 100, "es", f"src{i}", 1) for i in range(1, 40)],
             "b": [(161, long_text, "es", "src1", 1), (2, "2 " * 100, "es", "src2", 1), (50, "y" * 300, "es", "s", 1), (51, "short", "es", "s", 1)],
             "c": [(181, long_text, "es", "src1", 1), (52, "z" * 300, "es", "s", 1)]}
    read = []
    for name, rows in parts.items():
        docs(spark, rows).coalesce(1).write.parquet(f"{base}/in/{name}")
        _, q = ingest_stateful(spark, f"{base}/in/*", target=f"{base}/t", glob="*.parquet")
        run_to_completion(q)
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
        state = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]][-1]
    assert read == [41, 4, 2]
    assert state["numRowsTotal"] == 42 and state["numRowsUpdated"] == 1
    got = sorted(r["song_id"] for r in spark.read.parquet(f"{base}/t").collect())
    assert got == sorted([*range(1, 40), 50, 52, 161])


def test_stateful_ingest_replays_a_lost_batch(spark):
    import glob
    import os
    from cantoria.streaming.ingest import ingest_stateful, run_to_completion
    base = tempfile.mkdtemp(prefix="cantoria-replay-")
    for name, ids in (("a", (1, 2)), ("b", (2, 3))):
        docs(spark, [(i, f"{i} " * 100, "es", f"src{i}", 1) for i in ids]).coalesce(1).write.parquet(f"{base}/in/{name}")
        _, q = ingest_stateful(spark, f"{base}/in/*", target=f"{base}/t", glob="*.parquet")
        run_to_completion(q)
    want = sorted(map(tuple, spark.read.parquet(f"{base}/t").select("song_id", "lote").collect()))
    last = max(glob.glob(f"{base}/t-checkpoint/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)                                   # the batch was written but never committed: it runs again
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    _, q = ingest_stateful(spark, f"{base}/in/*", target=f"{base}/t", glob="*.parquet")
    run_to_completion(q)
    assert sorted(map(tuple, spark.read.parquet(f"{base}/t").select("song_id", "lote").collect())) == want


def test_streams_read_a_table_of_part_files_like_one_file(spark):
    import os
    import shutil
    from cantoria.plans.catalog import QUERIES
    base = tempfile.mkdtemp(prefix="cantoria-parts-")
    rows = docs(spark, [(i, f"{i} line of some length here\n" * 10, "es", f"src{i}", 1) for i in range(1, 9)])
    rows.repartition(3).write.parquet(f"{base}/parts/documents.parquet")
    rows.coalesce(1).write.parquet(f"{base}/tmp")
    part = next(f for f in os.listdir(f"{base}/tmp") if f.startswith("part-"))
    os.makedirs(f"{base}/one")
    shutil.copy(f"{base}/tmp/{part}", f"{base}/one/documents.parquet")
    for name in ("incremental_ingest", "incremental_ingest_stateful", "incremental_rollup"):
        one, parts = (sorted(map(tuple, QUERIES[name](spark, f"{base}/{k}").collect())) for k in ("one", "parts"))
        assert one == parts and len(one) == 8
