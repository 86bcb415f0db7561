"""Helpers of the training-data operators: input tables, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a scratch folder of its own; a cluster without it
    is refused, since executors could not see each other's files."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _local_scratch()


_SCRATCH: list[str] = []


def _local_scratch() -> str:
    if not _SCRATCH:
        _SCRATCH.append(tempfile.mkdtemp(prefix="parlour-llm-", dir=os.environ.get("PARLOUR_SCRATCH", "/tmp")))
    return _SCRATCH[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def written_freed(df: DataFrame, tag: str) -> DataFrame:
    """``written``, after which the shuffle files of its job are deleted at once. Else they stay on disk until the
    driver's garbage collector finds that nothing refers to them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, tag)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later job reads: what came of them must have been written itself."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession._jsc
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc.hadoopConfiguration()).delete(place, True)


def worker_object(key: tuple, make):
    """An object that a Python worker keeps for the tasks that follow in it: functions come anew with each task,
    so it is held where all of them find it. It must be costly to make and the same for all tasks of ``key``."""
    store = sys.modules.setdefault("parlour_worker_objects", types.ModuleType("parlour_worker_objects")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character untouched. ``lower`` does just that where all is ASCII
    and is several times faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def packed(docs: DataFrame, **derived: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the derived columns, so that no column of the input
    can clash with an internal name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in derived.items()])
