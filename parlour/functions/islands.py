"""Gaps and islands: which intervals of a group hang together, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.session import checkpoint_dir


def islands(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """``df`` with ``island``: the first ``start`` of the run of intervals [start, end) of its group that the row belongs
    to. Intervals of different islands do not overlap (touching ones may be apart); bounds must not be null.

    Rows are dealt by ranges of (group, start), so that a large group lies in several; what a range must know of the
    ranges before it, how far they reach and where their last island begins, is one row a group and range."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, group, start).withColumn("_pid", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("_pid", group).orderBy(start, end)
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: str, name: str) -> DataFrame:
        part = df.groupBy("_pid", group).agg(F.max(value).alias("_v")).withColumn(name, F.max("_v").over(before)).drop("_v")
        return df.join(part, ["_pid", group])

    rows = carried(rows, end, "_reached").withColumn("_reach", F.greatest("_reached", F.max(end).over(here.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("_mark", F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.col(start)))
    rows = carried(rows, "_mark", "_marked").withColumn("_own", F.max("_mark").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("island", F.coalesce("_own", "_marked")).select(*df.columns, "island")
