"""Readers and writers."""

import os
import tempfile

from cantoria.sources import sinks
from cantoria.sources.reviews import read_reviews
from cantoria.sources.tables import read_songs


def test_write_if_absent_keeps_reviewed_sheet(spark):
    d = tempfile.mkdtemp(prefix="cantoria-sink-")
    first = spark.createDataFrame([(1, "kept")], "id int, v string")
    sinks.save(first, f"{d}/sheet")
    sinks.save(spark.createDataFrame([(2, "new")], "id int, v string"), f"{d}/sheet", if_absent=True)
    assert [tuple(r) for r in spark.read.parquet(f"{d}/sheet").collect()] == [(1, "kept")]
    sinks.append(spark.createDataFrame([(3, "more")], "id int, v string"), f"{d}/sheet")
    assert spark.read.parquet(f"{d}/sheet").count() == 2


def test_flow_stats_json(spark):
    one = spark.createDataFrame([(592, 600, 1085, 2238, 1153)],
                                "regex_in long, kmeans_in long, deduplicado long, smote_out long, sinteticos_creados long")
    assert '"sinteticos_creados": 1153' in sinks.flow_stats_json(one)


def test_read_songs_csv_multiline_bom(spark):
    d = tempfile.mkdtemp(prefix="cantoria-csv-")
    with open(os.path.join(d, "songs.csv"), "w", encoding="utf-8-sig") as f:
        f.write('song_id,artist,album,year,song,lyrics\n1,A,B,1990,S,"line one\nline two"\n2,A,B,1991,T,\n')
    df = read_songs(spark, d, fmt="csv")
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["lyrics"] == "line one\nline two" and rows[0]["song_id"] == 1


def test_read_reviews_union_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="cantoria-rev-")
    with open(os.path.join(d, "5_booster_AR.csv"), "w") as f:
        f.write("verso_texto,val_AR\nuno,2\ndos,\n")
    with open(os.path.join(d, "5_booster_GO_v2.csv"), "w") as f:
        f.write("verso_texto,val_GO\ntres,1\n")
    df = read_reviews(spark, [os.path.join(d, "5_booster_AR.csv"), os.path.join(d, "5_booster_GO_v2.csv")])
    got = {r["verso_texto"]: (r["origen"], r["val_AR"], r["val_GO"]) for r in df.collect()}
    assert got == {"uno": ("Regex", 2, 0), "dos": ("Regex", 0, 0), "tres": ("K-Means", 0, 1)}


def test_scale_defaults_never_override(spark):
    from cantoria.session import apply_scale_defaults
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    done = apply_scale_defaults(spark)
    assert "spark.sql.files.maxPartitionBytes" not in done
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in (str(64 << 20), "64MB", "67108864b")


def test_csv_columns_by_header_name(spark):
    d = tempfile.mkdtemp(prefix="cantoria-csv-")
    with open(f"{d}/songs.csv", "w", encoding="utf-8") as f:
        f.write('\ufeffartist,album,year,song,lyrics\nana,A,1999,uno,"line one\nline ""two"""\nbob,B,nan,dos,\ncid,C,2001,tres,text\n')
    rows = read_songs(spark, f"{d}/songs.csv", fmt="csv").orderBy("song_id").collect()
    assert [(r["artist"], r["year"], r["song"], r["lyrics"]) for r in rows] == [
        ("ana", "1999", "uno", 'line one\nline "two"'), ("cid", "2001", "tres", "text")]
    assert rows[0]["song_id"] < rows[1]["song_id"]


def test_save_vectors_models_scores_every_label_alike(spark):
    from cantoria.fixed import DIMS
    from cantoria.plans.catalog import QUERIES, reset_stages
    d = tempfile.mkdtemp(prefix="cantoria-models-")
    words = ["this are sus", "from con avec", "were por pour", "which los les", "have una une", "not del des"]
    text = "\n".join(f"{w} and a verse of line {i}" for i, w in enumerate(words * 3))
    spark.createDataFrame([(i, f"{text}\n{words[i % 6]} closes song {i}", "es", f"src{i}", 1) for i in range(12)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    reset_stages()
    rows = QUERIES["save_vectors_models"](spark, d).collect()
    assert rows and all(r[f"a_{k}"] == r[f"b_{k}"] is not None for r in rows for k in DIMS)
    assert all(len({r[f"a_{k}"] for r in rows}) > 1 for k in DIMS)
