"""Work along a global order without one task for all rows, or one for all rows of a group.

Rows are dealt by sampled ranges of the order and written with the number of their range, so that every later step
sees the same ranges. Windows run within a range; what passes from one range to the next is a row or a few sums a
range, which go by way of the driver (their number is that of the partitions, not of the rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlour.llm.common import n_partitions, written


def ranged(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``df`` with its range's number in ``pid``, written to the shared folder."""
    return written(df.repartitionByRange(n_partitions(df.sparkSession), *order).withColumn("pid", F.spark_partition_id()), tag)


def running(df: DataFrame, group: str, order: list[Column], **values: Column) -> DataFrame:
    """Sums of ``values`` (long, not null) over the rows of a group up to each row, in the order that ``df`` is ranged by
    (the group first), and over the whole group as ``<name>_all``. A group may lie in any number of ranges."""
    spark = df.sparkSession
    sums = [F.sum(v).alias(k) for k, v in values.items()]
    edges = df.groupBy("pid").agg(F.min(group).alias("low"), F.max(group).alias("high")).orderBy("pid").collect()
    over = {a["high"] for a, b in zip(edges, edges[1:]) if a["high"] == b["low"]}  # groups on both sides of an edge
    parts = df.filter(F.col(group).isin(*over)).groupBy(group, "pid").agg(*sums).orderBy(group, "pid").collect() if over else []
    so_far: dict = {}
    before = []
    for r in parts:
        have = so_far.setdefault(r[group], [0] * len(values))
        before.append([r[group], r["pid"], *have])
        so_far[r[group]] = [a + r[k] for a, k in zip(have, values)]
    rows = [tuple(b + so_far[b[0]]) for b in before]
    names = [f"{k}_before" for k in values] + [f"{k}_whole" for k in values]
    kind = dict(df.dtypes)[group]
    offsets = spark.createDataFrame(rows, f"`{group}` {kind}, pid int" + "".join(f", {k} long" for k in names))
    up_to = Window.partitionBy("pid", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("pid", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({k: F.sum(v).over(up_to) for k, v in values.items()} | {f"{k}_all": F.sum(v).over(whole) for k, v in values.items()})
    out = out.join(F.broadcast(offsets), [group, "pid"], "left")
    return out.withColumns({k: F.col(k) + F.coalesce(f"{k}_before", F.lit(0)) for k in values}
                           | {f"{k}_all": F.coalesce(f"{k}_whole", f"{k}_all") for k in values}).drop(*names)


def neighbours(df: DataFrame, order: list[Column], columns: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with structs ``before`` and ``after``: ``columns`` of the rows next to each in the order (null at its ends).
    ``df`` is ranged by ``order``, which is ``columns`` (numbers, not null), each ascending but for those ``descending``."""
    signed = F.struct(*[(-F.col(c) if c in descending else F.col(c)).alias(c) for c in columns])
    ends = df.groupBy("pid").agg(F.min(signed).alias("first"), F.max(signed).alias("last")).orderBy("pid").collect()  # a row a range
    real = lambda s: tuple(-s[c] if c in descending else s[c] for c in columns)
    rows = [(r["pid"], real(ends[i - 1]["last"]) if i else None, real(ends[i + 1]["first"]) if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    both = df.withColumn("own", F.struct(*columns))
    kind = both.schema["own"].dataType.simpleString()
    edges = df.sparkSession.createDataFrame(rows, f"pid int, edge_before {kind}, edge_after {kind}")
    in_range = Window.partitionBy("pid").orderBy(*order)
    out = both.withColumn("before", F.lag("own").over(in_range)).withColumn("after", F.lead("own").over(in_range)).join(F.broadcast(edges), "pid")
    return out.withColumns({"before": F.coalesce("before", "edge_before"), "after": F.coalesce("after", "edge_after")}).drop("own", "edge_before", "edge_after")
