"""Invoice paid totals kept current from streams of payments and refunds.

The reference updates ``total_paid`` with AFTER triggers as each payment or refund row arrives, changes or goes. Here the
changes are rows as a change feed gives them: an update carries the new row alone, a delete the key alone. Two
Structured Streaming queries follow one another. :func:`keep_rows` holds the current row of each payment and refund in
keyed state, a page of neighbouring keys together, and turns a change into signed amounts, what the old row gave is taken off and what the new one gives is
added, also where a row moves to another invoice. :func:`keep_totals` holds a running ``sum`` per invoice (stateful
aggregation in ``update`` mode, no watermark: an invoice can be paid at any time), and writes each micro-batch's changed
totals to a folder of its own under the sink. The current state is the latest row per invoice; :func:`compact` folds all
batches so far into one snapshot.

Nothing is counted twice after a failure: the signed amounts go through the file sink, which commits a batch once, a
batch of totals that is run again overwrites its own folder, and a change that is not newer than its row's last is ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.session import checkpoint_dir
from parlour.sources.schemas import MONEY


def signed_changes(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """(tid, amount) of changes of payments and refunds (streams or tables): a payment adds, a refund takes off,
    and a row with ``op`` = 'delete' does the opposite (an update is a delete of the old and an insert of the new
    row). Without a column ``op`` all rows are inserts."""
    def amounts(df: DataFrame, column: str, sign: int) -> DataFrame:
        op = F.when(F.col("op") == "delete", -sign).otherwise(sign) if "op" in df.columns else F.lit(sign)
        return df.select("tid", (F.col(column) * op).cast(MONEY).alias("amount"))

    return amounts(payments, "payment_amount", 1).unionByName(amounts(refunds, "refund_amount", -1))


def keep_totals(changes: DataFrame, sink: str, checkpoint: str) -> None:
    """Run the stream ``changes`` (tid, amount) over everything available, from where ``checkpoint`` left off."""
    totals = changes.groupBy("tid").agg(F.sum("amount").alias("total_paid"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(upsert).trigger(availableNow=True).start())
    q.awaitTermination()


CHANGE = "kind string, key long, seq long, op string, tid long, amount decimal(10,2)"


def change_rows(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """Changes (``CHANGE``) of payments (pid, seq, op, tid, payment_amount) and refunds (refid, seq, op, tid, refund_amount),
    streams or tables. ``seq`` orders the changes of a row, ``op`` is insert, update or delete."""
    def rows(df: DataFrame, kind: str, key: str, amount: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "seq", "op", "tid", F.col(amount).cast(MONEY).alias("amount"))

    return rows(payments, "payment", "pid", "payment_amount").unionByName(rows(refunds, "refund", "refid", "refund_amount"))


PAGE_BITS = 10  # rows of a kind are held together by pages of as many keys


def _apply_changes(key, frames, state):
    """One page's changes of a micro-batch: the signed amounts, in cents, that invoices gain. The state holds the page's rows,
    sorted by key, as five rows of whole numbers: key, seq, tid, cents and whether the row is there (a deleted row leaves its
    last seq behind, against late changes)."""
    import numpy as np
    import pandas as pd

    held = np.frombuffer(state.get[0], np.int64).reshape(5, -1) if state.exists else np.zeros((5, 0), np.int64)
    newest = None
    for f in frames:
        f = f if newest is None else pd.concat([newest, f], ignore_index=True)
        newest = f.sort_values("seq", ascending=False, kind="stable").drop_duplicates("key")  # of equal seq the first
    new = newest.sort_values("key")[["key", "seq", "tid", "cents", "there"]].to_numpy(np.int64).T
    at = np.searchsorted(held[0], new[0])
    known = np.isin(new[0], held[0])
    old = held[:, np.where(known, at, 0)] if held.shape[1] else np.zeros_like(new)
    newer = ~known | (new[1] > old[1])
    new, old, known = new[:, newer], old[:, newer], known[newer]
    kept = np.concatenate([held[:, ~np.isin(held[0], new[0])], new], 1)
    state.update((np.ascontiguousarray(kept[:, np.argsort(kept[0])]).tobytes(),))
    was, now = old[:, known & (old[4] == 1)], new[:, new[4] == 1]
    gained = pd.DataFrame({"tid": np.concatenate([was[2], now[2]]), "cents": np.concatenate([-was[3], now[3]])}).groupby("tid", as_index=False).sum()
    yield gained[gained["cents"] != 0].astype("int64")


def keep_rows(changes: DataFrame, sink: str, checkpoint: str) -> None:
    """Run the stream ``changes`` (``CHANGE``) over everything available: the signed amounts (tid, cents) go to ``sink``."""
    cents = (F.col("amount") * F.when(F.col("kind") == "refund", -100).otherwise(100)).cast("long")
    there = ~F.col("op").eqNullSafe("delete") & F.col("tid").isNotNull()
    none = F.lit(0).cast("long")
    rows = changes.where(F.col("seq").isNotNull()).select(
        "kind", F.shiftright("key", PAGE_BITS).alias("page"), F.coalesce("key", none).alias("key"), "seq",
        F.coalesce("tid", none).alias("tid"), F.coalesce(cents, none).alias("cents"), there.cast("long").alias("there"))
    deltas = rows.groupBy("kind", "page").applyInPandasWithState(_apply_changes, "tid long, cents long", "rows binary", "append", "NoTimeout")
    q = (deltas.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_changes(spark: SparkSession, source: str, base: str) -> str:
    """Bring the totals under ``base`` up to date with the change files (``CHANGE``) in ``source``, from where the last run
    left off, and return the sink of the totals."""
    keep_rows(spark.readStream.schema(CHANGE).parquet(source), f"{base}/amounts", f"{base}/_rows")
    amounts = spark.readStream.schema("tid long, cents long").parquet(f"{base}/amounts")
    keep_totals(amounts.select("tid", (F.col("cents").cast("decimal(18,0)") / 100).cast(MONEY).alias("amount")), f"{base}/state", f"{base}/_totals")
    return f"{base}/state"


def current_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Latest total per invoice from the batches' folders (and a snapshot's, if compacted)."""
    s = spark.read.parquet(sink)
    return s.groupBy("tid").agg(F.max_by("total_paid", "batch_id").alias("total_paid"))


def compact(spark: SparkSession, sink: str, into: str) -> str:
    """Write the latest total per invoice of ``sink`` as one snapshot ``into`` a new sink, which later batches
    may follow (they have higher batch ids), and return it. The old sink can then be dropped."""
    s = spark.read.parquet(sink)
    last = s.agg(F.max("batch_id")).first()[0]
    current_totals(spark, sink).write.mode("overwrite").parquet(f"{into}/batch_id={last}")
    return into


def change_feed(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Two parts of changes that end in the given payments and refunds: rows entered wrongly or on another invoice and
    corrected later, rows entered and deleted, rows deleted and entered again, a change that comes late."""
    def parts(df: DataFrame, key: str, amount: str) -> list[DataFrame]:
        k, own = F.col(key), [F.col("tid"), F.col(amount)]

        def change(seq: int, op: str, at=k, tid=own[0], value=own[1]):
            return F.struct(at.alias(key), F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), tid.cast("long").alias("tid"), value.cast(MONEY).alias(amount))

        wrong, moved, late, again, ghost = k % 3 == 0, k % 5 == 0, k % 4 == 3, k % 7 == 2, -k - 1
        none = F.lit(None)
        first = [F.when(~late, change(1, "insert", tid=F.when(moved, own[0] + 1).otherwise(own[0]), value=F.when(wrong, own[1] + 10).otherwise(own[1]))),
                 F.when(k % 11 == 0, change(1, "insert", ghost))]
        later = [F.when(~late & (wrong | moved), change(2, "update")), F.when(k % 11 == 0, change(2, "delete", ghost, none, none)),
                  F.when(again, change(3, "delete", k, none, none)),
                 F.when(late & ~again, change(4, "insert")), F.when(again, change(4, "insert")), F.when(~late & wrong, change(1, "update", value=own[1] + 99))]
        return [df.select(F.explode(F.array_compact(F.array(*p))).alias("c")).select("c.*") for p in (first, later)]

    return [change_rows(p, r) for p, r in zip(parts(t["payments"], "pid", "payment_amount"), parts(t["refunds"], "refid", "refund_amount"))]


def stream_net_paid(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """D9 end to end: the change feed of ``t`` arrives in two parts, the streams stop and start again between them; every
    invoice with its streamed total_paid (0 when nothing arrived)."""
    base = f"{checkpoint_dir(spark)}/net_paid-{uuid.uuid4().hex}"
    for part in change_feed(t):
        part.write.mode("append").parquet(f"{base}/changes")
        sink = run_changes(spark, f"{base}/changes", base)
    return t["transactions"].select("tid").join(current_totals(spark, sink), "tid", "left").select(
        "tid", F.coalesce("total_paid", F.lit(0).cast(MONEY)).cast(MONEY).alias("total_paid"))
