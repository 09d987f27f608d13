"""Session construction and lineage cutting.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared folder; we only read it.
Tests and local runs get a scratch folder of their own when the setting is absent.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "cantoria", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Broadcast only what the planner can prove small; explicit broadcasts are size-checked in code.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


SCALE_DEFAULTS = {
    # read splits and shuffle partitions sized for executor memory; AQE starts wide and coalesces
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    # long texts: keep Arrow batches bounded in bytes, not only in rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def apply_scale_defaults(spark: SparkSession, overrides: dict | None = None) -> dict:
    """Cluster profile for corpus-scale runs: set each of SCALE_DEFAULTS only where the session leaves it
    unset (a value chosen by the cluster always wins). Returns what was set."""
    done = {}
    for k, v in {**SCALE_DEFAULTS, **(overrides or {})}.items():
        try:
            current = spark.conf.get(k, None)
        except Exception:  # noqa: BLE001
            current = None
        if current is None:
            spark.conf.set(k, v)
            done[k] = v
    return done


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only when the cluster names none."""
    current = spark.conf.get(CHECKPOINT_KEY, None)
    try:
        current = current or spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext on the client (e.g. Spark Connect)
        pass
    if not current:
        try:
            master = spark.sparkContext.master
        except Exception:  # noqa: BLE001
            master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", str(master)):      # local-cluster has executors of its own
            # a machine-local folder is not reachable by other executors: a cluster must name a shared one
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder (e.g. on the cluster's distributed store)")
        current = tempfile.mkdtemp(prefix="cantoria-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001
        pass
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: packed and compressed, so it takes a fraction of the disk of a
    checkpoint of the same rows, and columns that nobody reads are left on it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
