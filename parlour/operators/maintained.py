"""Invoice totals and states (D2, D4-D6) kept current from change batches instead of recomputed.

The reference's triggers sum an invoice's items or payments anew at every change of one of them. Here a batch of changes
becomes signed amounts per invoice; these are added to the stored totals of the invoices that they touch, and the state
follows from the new totals. The table of invoices is laid out by ranges of ``tid``: a batch reads the ranges it touches
and writes the touched invoices, as a new version beside the old ones; :func:`compact` folds the versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.operators import derive as dv
from parlour.sources.schemas import MONEY

RANGE = 1_000_000  # invoices of a range
COLUMNS = ("tid", "total_cost", "total_discount", "total_paid", "exit_time", "status")


def _signed(changes: DataFrame, amounts: dict[str, tuple[str, int]], event: bool) -> DataFrame:
    """(tid, cost, discount, paid, event) of changes (``old`` and ``new``: the row before and after, null where there is none)."""
    def side(row: str, sign: int):
        money = {name: (F.col(f"{row}.{amounts[name][0]}") * (sign * amounts[name][1])).cast("decimal(18,2)") if name in amounts else F.lit(0).cast("decimal(18,2)")
                 for name in ("cost", "discount", "paid")}
        return F.when(F.col(row).isNotNull(), F.struct(F.col(f"{row}.tid").alias("tid"), *[v.alias(k) for k, v in money.items()]))

    both = F.explode(F.array_compact(F.array(side("old", -1), side("new", 1))))
    return changes.select(both.alias("c")).select("c.*", F.lit(event).alias("event"))


def item_amounts(changes: DataFrame) -> DataFrame:
    """Signed amounts of changes of items: (old, new) with tid, cost, item_discount."""
    return _signed(changes, {"cost": ("cost", 1), "discount": ("item_discount", 1)}, False)


def payment_amounts(changes: DataFrame) -> DataFrame:
    """Signed amounts of changes of payments: (old, new) with tid, payment_amount."""
    return _signed(changes, {"paid": ("payment_amount", 1)}, True)


def refund_amounts(changes: DataFrame) -> DataFrame:
    """Signed amounts of changes of refunds: (old, new) with tid, refund_amount."""
    return _signed(changes, {"paid": ("refund_amount", -1)}, True)


def _range():
    return F.floor(F.col("tid") / RANGE).cast("long")


def start(transactions: DataFrame, path: str) -> None:
    """Lay out the invoices with their stored totals as version 0."""
    _write(transactions.select(*COLUMNS), path, 0)


def _write(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumn("_range", _range()).hint("rebalance", "_range").write.mode("overwrite").partitionBy("_range").parquet(f"{path}/_version={version}")


def current(spark: SparkSession, path: str, before: int | None = None, ranges: list[int] | None = None) -> DataFrame:
    """The latest version of every invoice: of the versions below ``before``, and of those in ``ranges`` if given."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("_version") < before)
    if ranges is not None:
        rows = rows.where(F.col("_range").isin(*ranges))
    row = F.struct(*[c for c in COLUMNS if c != "tid"])
    return rows.groupBy("tid").agg(F.max_by(row, "_version").alias("r")).select("tid", "r.*")


def touched_invoices(spark: SparkSession, path: str, version: int, amounts: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """The invoices that batch ``version`` touches, as they are after it. ``amounts``: signed amounts; ``exits``: (tid, exit_time).

    D5 holds for each touched invoice; one with a payment, refund or exit in the batch is completed once nothing is
    outstanding and the exit is recorded (D6). An exit that is recorded already stays. Unknown invoices are left out."""
    exits = spark.createDataFrame([], "tid long, exit_time timestamp_ntz") if exits is None else exits
    left = exits.select("tid", *[F.lit(0).cast("decimal(18,2)").alias(c) for c in ("cost", "discount", "paid")], F.lit(True).alias("event"), F.col("exit_time").alias("left_at"))
    gained = amounts.withColumn("left_at", F.lit(None).cast("timestamp_ntz")).unionByName(left).groupBy("tid").agg(
        F.sum("cost").alias("cost"), F.sum("discount").alias("discount"), F.sum("paid").alias("paid"), F.bool_or("event").alias("event"), F.min("left_at").alias("left_at"))
    ranges = [r[0] for r in amounts.select("tid").union(exits.select("tid")).select(_range().alias("r")).distinct().collect()]  # ranges, not invoices
    j = current(spark, path, version, ranges).join(gained, "tid")
    plus = lambda total, gain: (F.coalesce(total, F.lit(0)) + F.col(gain)).cast(MONEY)
    j = j.select("tid", plus("total_cost", "cost").alias("total_cost"), plus("total_discount", "discount").alias("total_discount"),
                 plus("total_paid", "paid").alias("total_paid"), F.coalesce("exit_time", "left_at").alias("exit_time"), "status", "event")
    owed = dv.outstanding_col(F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    state = dv.status_rule(F.col("status"), F.col("total_cost"), F.col("total_discount"), F.col("total_paid"))
    state = F.when(F.col("event"), dv.completion_rule(state, owed, F.col("exit_time"))).otherwise(state)
    return j.withColumn("status", state).select(*COLUMNS)


def apply_batch(spark: SparkSession, path: str, version: int, amounts: DataFrame, exits: DataFrame | None = None) -> None:
    """Write the touched invoices as version ``version`` (batches number from 1; one that is run again overwrites its own)."""
    _write(touched_invoices(spark, path, version, amounts, exits), path, version)


def compact(spark: SparkSession, path: str, into: str, version: int) -> None:
    """Write the latest version of every invoice as one version of a new table, which later batches may follow."""
    _write(current(spark, path), into, version)
