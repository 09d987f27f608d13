"""Incremental jobs on Structured Streaming.

R1 ``ingest_stream``: new document files arrive in a folder; each micro-batch is mapped to songs, length-filtered
(P5), de-duplicated by fingerprint inside the batch (first song_id wins) and against everything already in the
target table (fingerprints never expire, so no watermark: the target table *is* the state), then appended.
Each batch is written into its own ``lote=<batch id>`` partition with dynamic partition overwrite, so a batch
replayed after a failure replaces its own output instead of duplicating it.

R1 ``ingest_stateful``: the same result with the fingerprints in Spark's keyed streaming state (one flag a fingerprint, in
RocksDB), so a batch shuffles and looks up its own rows only, however large the target has grown.

R2 ``rollup_stream``: per-year additive counters of the stanza rollup (songs, stanzas, active stanzas, density
sum) kept by Spark's streaming aggregation state (one small row per year) and published as a complete snapshot
each trigger.

Both write under the shared checkpoint folder named by ``spark.checkpoint.dir`` (never a machine-local path).
"""

from __future__ import annotations

import uuid
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantoria.fixed import MIN_LYRIC_CHARS, STANDIN_LEXICON
from cantoria.functions.text import fingerprint
from cantoria.operators.rollup import rollup_columns, with_scored_units
from cantoria.operators.select import dedupe
from cantoria.session import ensure_checkpoint_dir
from cantoria.sources.tables import songs_from_documents

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_files(sf_dir: str, name: str = "documents") -> str:
    """Pattern for the files of a table, to stream with ``glob=None``: the table is one file or a folder of part files.
    A pattern, as a stream takes a plain path for a folder."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def document_stream(spark: SparkSession, folder: str, glob: str | None = "documents*.parquet",
                    files_per_trigger: int | None = None) -> DataFrame:
    """``glob`` filters the names of the files themselves (None: every file), not those of folders above them."""
    reader = spark.readStream.schema(DOCUMENTS_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _known(spark: SparkSession, target: str) -> DataFrame | None:
    """Fingerprints of the target, or None before its first batch; any other failure to read it is raised."""
    try:
        return spark.read.schema("huella string, lote string").parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _ingest_batch(target: str, min_chars: int, run_id: str = ""):
    """``run_id`` names the checkpoint: batches of different checkpoints never share a partition of the target."""
    def run(batch: DataFrame, batch_id: int) -> None:
        lote = f"{run_id}b{batch_id:08d}"
        songs = (songs_from_documents(batch).where(F.length("lyrics") >= min_chars)
                 .withColumn("huella", fingerprint("artist", "song")))
        first = dedupe(songs, "huella", ["song_id"])
        seen = _known(batch.sparkSession, target)
        if seen is not None:
            first = first.join(seen.where(F.col("lote") != lote).select("huella"), "huella", "left_anti")
        (first.withColumn("lote", F.lit(lote)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(target))
    return run


def ingest_stream(spark: SparkSession, folder: str, target: str | None = None, min_chars: int = MIN_LYRIC_CHARS,
                  glob: str | None = "documents*.parquet", available_now: bool = True, checkpoint: str | None = None) -> tuple[str, object]:
    """Start R1; returns (target path, StreamingQuery). The checkpoint belongs to the target (by default it lies beside
    it), so a restart on the same target goes on where the last run ended. With ``available_now`` the query drains
    the folder and stops."""
    target = (target or _scratch(spark, "ingest-table")).rstrip("/")
    ckpt = checkpoint or f"{target}-checkpoint"
    run_id = f"c{zlib.crc32(ckpt.encode()):08x}-"
    w = (document_stream(spark, folder, glob).writeStream.foreachBatch(_ingest_batch(target, min_chars, run_id))
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return target, w.start()


def _first_of_key(key, parts, state):
    """The first song (least id) of a fingerprint that no earlier batch had. A key's rows stream by: one is held."""
    best = None
    for rows in parts:
        if not state.exists and len(rows):
            best = rows if best is None else pd.concat([best, rows])
            best = best.sort_values("song_id", kind="stable").head(1)
    if best is not None:
        state.update((True,))
        yield best


def ingest_stateful(spark: SparkSession, folder: str, target: str | None = None, min_chars: int = MIN_LYRIC_CHARS,
                    glob: str | None = "documents*.parquet", available_now: bool = True, checkpoint: str | None = None,
                    files_per_trigger: int | None = None) -> tuple[str, object]:
    """Start R1 with the fingerprints in keyed state; returns (target path, StreamingQuery). The checkpoint holds the
    state: one target, one checkpoint (by default it lies beside the target), and a restart goes on with what it knows.
    A batch replayed after a failure sees the state from before it and replaces its own partition of the target."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    target = (target or _scratch(spark, "ingest-table")).rstrip("/")
    songs = (songs_from_documents(document_stream(spark, folder, glob, files_per_trigger)).where(F.length("lyrics") >= min_chars)
             .withColumn("huella", fingerprint("artist", "song")))
    first = songs.groupBy("huella").applyInPandasWithState(_first_of_key, songs.schema, "visto boolean", "append", "NoTimeout")

    def append(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("lote", F.lit(f"b{batch_id:08d}")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(target))

    w = first.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint or f"{target}-checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return target, w.start()


def rollup_stream(spark: SparkSession, folder: str, target: str | None = None, lexicon=STANDIN_LEXICON,
                  glob: str | None = "documents*.parquet", available_now: bool = True, checkpoint: str | None = None) -> tuple[str, object]:
    """Start R2; returns (target path, StreamingQuery). The checkpoint, which holds the counters, belongs to the
    target as in R1, so a restart adds to them."""
    target = (target or _scratch(spark, "rollup-table")).rstrip("/")
    ckpt = checkpoint or f"{target}-checkpoint"
    songs = songs_from_documents(document_stream(spark, folder, glob))
    scored = with_scored_units(songs, lexicon, "stanza").select("year", *rollup_columns())
    agg = (scored.groupBy("year").agg(
        F.count(F.lit(1)).alias("canciones"),
        F.sum("total_estrofas").alias("estrofas"),
        F.sum("estrofas_activas").alias("activas"),
        F.sum("densidad_semantica_v2").alias("suma_densidad"),
        F.count("densidad_semantica_v2").alias("con_estrofas")))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    w = agg.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return target, w.start()


def run_to_completion(query) -> None:
    """Wait until the query has drained its input, however long that takes; raises what ended it otherwise."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
