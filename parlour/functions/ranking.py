"""RANK / LAG / LEAD over a global order without pulling all rows into one task.

Spark runs an un-partitioned window in a single task. Here the rows are range-partitioned on
the order (value DESC, tiebreak ASC), which also splits a heavily tied value (say a third of
the rows at revenue 0) by the tie-break. Each range partition computes local row numbers,
ranks and neighbours; a per-partition summary (one row per partition) supplies the global
offsets, the neighbours across partition edges and the ties that run in from earlier
partitions. The summary is bounded by the partition count and is broadcast back.

The range-partitioned rows are checkpointed (reliably, in the shared checkpoint folder) so
that the rows and their summary see the same partition boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.session import checkpoint_dir


def global_rank_lag_lead(df: DataFrame, value: str, tiebreak: str, n_parts: int | None = None, prefix: str = "") -> DataFrame:
    """Adds ``rank`` (RANK() OVER (ORDER BY value DESC)), ``above`` / ``below`` (LAG / LEAD of
    ``value`` OVER (ORDER BY value DESC, tiebreak ASC)). ``tiebreak`` must be unique."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(value), F.asc(tiebreak)]
    r = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)

    w = Window.partitionBy("_pid").orderBy(*order)
    loc = r.select("*", F.row_number().over(w).alias("_pos"),
                   F.rank().over(Window.partitionBy("_pid").orderBy(F.desc(value))).alias("_lrank"),
                   F.lag(value).over(w).alias("_lag"), F.lead(value).over(w).alias("_lead"))

    per_val = r.groupBy("_pid", value).agg(F.count(F.lit(1)).alias("_n"))
    summ = per_val.groupBy("_pid").agg(
        F.sum("_n").alias("_cnt"), F.max(value).alias("_first"), F.min(value).alias("_last"),
        F.min_by("_n", value).alias("_tail"))
    # the summary has one row per partition: ordering it in one task is cheap and bounded
    ow = Window.orderBy("_pid")
    summ = summ.select("*", F.coalesce(F.sum("_cnt").over(ow.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias("_start"),
                       F.lag("_last").over(ow).alias("_prev_last"), F.lead("_first").over(ow).alias("_next_first"))
    # ties running into partition p: tails of earlier partitions ending on p's first value
    runs = summ.select(F.col("_pid").alias("_q"), F.col("_last").alias("_v"), F.col("_tail").alias("_qtail"))
    ties = summ.select("_pid", F.col("_first").alias("_v")).join(F.broadcast(runs), "_v").where(
        F.col("_q") < F.col("_pid")).groupBy("_pid").agg(F.sum("_qtail").alias("_ties"))
    summ = summ.join(ties, "_pid", "left").fillna(0, ["_ties"])

    j = loc.join(F.broadcast(summ), "_pid")
    rank = (F.col("_start") + F.col("_lrank")
            - F.when(F.col(value) == F.col("_first"), F.col("_ties")).otherwise(F.lit(0)))
    above = F.when(F.col("_pos") == 1, F.col("_prev_last")).otherwise(F.col("_lag"))
    below = F.when(F.col("_pos") == F.col("_cnt"), F.col("_next_first")).otherwise(F.col("_lead"))
    return j.select(*df.columns, rank.cast("long").alias(f"{prefix}rank"), above.alias(f"{prefix}above"),
                    below.alias(f"{prefix}below"))
