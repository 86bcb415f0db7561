"""Operator 10 (native): exact dedup by content sort.

Texts are normalised, range-partitioned by sampled splitters, sorted externally within each partition,
and neighbouring rows are compared in full; of each run of equal texts one row stays.

Scale: splitters are sampled on (first 64 characters, 64-bit hash, salt), so that the driver never holds
whole texts; the rest of the order is the text itself. The text is shuffled once. A text held by more than
n/2P rows (P shuffle partitions; hence at most 2P such texts) is split over salted runs whose totals come
from a map-side combined count of those texts alone; that table has at most 2P rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.llm.common import ascii_lower, n_partitions, packed, written

SPLITTER_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                carry: bool = False, result_col: str = "dedup") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" keeps the smallest identifier of equal texts, "max" the largest. ``carry=True`` returns
    the columns of ``docs`` instead of the identifier, plus the four result columns in a struct ``result_col``.

    A null text counts as the empty text. A null identifier loses against any other; if a group has none,
    keep_id is null and one of its rows stays. Of rows that repeat identifier and text, one stays. An empty
    table gives an empty result. Other columns play no part, whatever their names."""
    spark = docs.sparkSession
    p = n_partitions(spark)
    src = packed(docs, id=F.col(id_col), norm=ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    src = (src if carry else src.drop("row")).withColumn("h", F.xxhash64("norm"))

    counts = src.groupBy("h").agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.sum("n") / F.lit(2 * p), F.lit(2.0)).alias("most"))
    hot = counts.join(F.broadcast(total), F.col("n") > F.col("most")).select("h", F.ceil(F.col("n") / F.col("most")).cast("int").alias("salts"))
    hot = written(hot, "op10-hot")  # at most 2P rows
    best = F.min if keep == "min" else F.max
    whole = (src.join(F.broadcast(hot), "h").groupBy("h", "norm").agg(best("id").alias("hot_keep"), F.count("*").alias("hot_n"))
             .select("h", F.sha2("norm", 256).alias("sha"), "hot_keep", "hot_n"))
    whole = written(whole, "op10-whole")  # one row per hot text

    runs = (src.join(F.broadcast(hot), "h", "left")
            .withColumn("head", F.substring("norm", 1, SPLITTER_CHARS))
            .withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(0)))
            .drop("salts")
            .repartitionByRange(p, "head", "h", "salt"))
    same = Window.partitionBy("head", "h", "norm", "salt")  # satisfied by the range partitioning: sorts, no shuffle
    order = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    runs = (runs.withColumn("rn", F.row_number().over(same.orderBy(order)))
            .withColumn("run_keep", best("id").over(same))
            .withColumn("run_n", F.count("*").over(same))
            .withColumn("sha", F.sha2("norm", 256)).drop("norm", "head"))
    out = (runs.join(F.broadcast(whole), ["h", "sha"], "left")
           .withColumn("keep_id", F.when(F.col("hot_n").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep")))
           .withColumn("group_size", F.coalesce("hot_n", "run_n"))
           .withColumn("kept", (F.col("rn") == 1) & F.col("run_keep").eqNullSafe(F.col("keep_id"))))
    result = [F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("sha").alias("text_sha256")]
    if carry:
        return out.select("row.*", F.struct(*result).alias(result_col))
    return out.select(F.col("id").alias("doc_id"), *result)
