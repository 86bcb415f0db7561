"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "parlour", shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume: AQE on, UTC, UI off.

    On a cluster the master, memory and shuffle-partition count come from spark-submit; the
    defaults below only apply when nothing else set them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # plans show a scan's filters whole, however long the numbers of its columns have become
        .config("spark.sql.maxMetadataStringLength", "1000")
        # D9 keeps unbounded per-invoice state; off-heap
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; Spark's own checkpoints go there too.

    Only a local session without that setting (tests) gets a fresh scratch folder; elsewhere executors
    could not see it, so that the missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="parlour-ckpt-", dir=os.environ.get("PARLOUR_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)  # appends a random sub-folder
    return sc.getCheckpointDir() or d


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder as Parquet. The shuffle files of the job that wrote it are deleted with it: else
    they would lie on disk beside those of the jobs that follow."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
