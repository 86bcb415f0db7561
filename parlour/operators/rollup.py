"""M2-M4 and T2 from a daily summary: sums and counts a day and key, refreshed for the days that changed.

A period is a range of whole days, read from the summary, and the open day, read from the facts up to the instant. The
summary is additive and laid out by day; a refresh reads the facts of the given days alone and replaces these days."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.functions.temporal import PERIODS, as_datetime, period_starts, today, ts_lit
from parlour.operators.management import DONE

SUMMED = "decimal(38,2)"  # sums of money of any number of rows

SCHEMA = {
    "payments": f"payment_method string, known boolean, amount {SUMMED}, n long, _day date",
    "items": f"eid long, known boolean, done boolean, net {SUMMED}, n long, _day date",
}


def _in_days(column: str, days: list[date]) -> F.Column:
    """A range of time for each run of neighbouring days, so that the filter reaches the scan."""
    out, days = F.lit(False), sorted(set(days))
    while days:
        n = next((i for i in range(1, len(days)) if days[i] != days[0] + timedelta(days=i)), len(days))
        lo = datetime(days[0].year, days[0].month, days[0].day)
        out = out | ((F.col(column) >= ts_lit(lo)) & (F.col(column) < ts_lit(lo + timedelta(days=n))))
        days = days[n:]
    return out


def summed(t: dict[str, DataFrame], payments: F.Column, items: F.Column) -> dict[str, DataFrame]:
    """The summary of the payments and items that the filters let pass."""
    tx = t["transactions"].select("tid", F.col("status").isin(*DONE).alias("_done"))
    pay = t["payments"].where(payments).join(tx, "tid", "left")
    it = t["transaction_items"].where(items).join(tx, "tid", "left")
    known = F.col("_done").isNotNull().alias("known")
    return {
        "payments": pay.groupBy("payment_method", known, F.to_date("payment_time").alias("_day"))
        .agg(F.sum("payment_amount").cast(SUMMED).alias("amount"), F.count(F.lit(1)).alias("n")),
        "items": it.groupBy(F.col("therapist_eid").alias("eid"), known, F.coalesce("_done", F.lit(False)).alias("done"), F.to_date("actual_start").alias("_day"))
        .agg(F.sum(F.col("cost") - F.col("item_discount")).cast(SUMMED).alias("net"), F.count(F.lit(1)).alias("n")),
    }


def refresh(t: dict[str, DataFrame], path: str, days: list[date] | None = None) -> None:
    """Write the summary under ``path``: of all days, or anew of ``days`` alone (a day without facts any more is emptied
    by an entry of zero)."""
    whole = days is None
    made = summed(t, F.col("payment_time").isNotNull() if whole else _in_days("payment_time", days), F.col("actual_start").isNotNull() if whole else _in_days("actual_start", days))
    for name, df in made.items():
        if not whole:
            zero = df.sparkSession.createDataFrame([(d,) for d in sorted(set(days))], "_day date")
            df = df.unionByName(zero, allowMissingColumns=True).fillna(0, ["n"])
        # a day's rows are at most a few for each therapist or method: days are dealt over all tasks, as each is a file to write
        df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(f"{path}/{name}")


def _parts(spark: SparkSession, t: dict[str, DataFrame], path: str, as_of, name: str, open_end: bool = False) -> DataFrame:
    """The summary's rows from the widest period's start to the day before ``as_of``, and those of the open day up to
    ``as_of`` (``open_end``: of all later facts), which carry its date."""
    d0, now = period_starts(as_of)["today"], as_datetime(as_of)
    kept = spark.read.schema(SCHEMA[name]).parquet(f"{path}/{name}").where(
        (F.col("_day") >= F.lit(min(period_starts(as_of).values()).date())) & (F.col("_day") < F.lit(today(as_of))))
    until = lambda c: (F.col(c) >= ts_lit(d0)) & (F.lit(True) if open_end else F.col(c) < ts_lit(now))
    return kept.unionByName(summed(t, until("payment_time"), until("actual_start"))[name].select(kept.columns))


def _flags(as_of) -> dict[str, F.Column]:
    return {p: F.col("_day") >= F.lit(s.date()) for p, s in period_starts(as_of).items()}


def _by_period(row: DataFrame, name: str) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias(name)) for p in PERIODS])))


def service_counts(spark: SparkSession, t: dict[str, DataFrame], path: str, as_of) -> DataFrame:
    """M2 from the summary."""
    parts = _parts(spark, t, path, as_of, "items").where("known")
    return _by_period(parts.agg(*[F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0).cast("long")).alias(p) for p, f in _flags(as_of).items()]), "service_count")


def revenue(spark: SparkSession, t: dict[str, DataFrame], path: str, as_of) -> DataFrame:
    """M3 from the summary."""
    parts = _parts(spark, t, path, as_of, "payments")
    return _by_period(parts.agg(*[F.coalesce(F.sum(F.when(f, F.col("amount"))), F.lit(0)).cast(SUMMED).alias(p) for p, f in _flags(as_of).items()]), "revenue")


def payment_breakdown(spark: SparkSession, t: dict[str, DataFrame], path: str, as_of) -> DataFrame:
    """M4 from the summary."""
    parts = _parts(spark, t, path, as_of, "payments").where("known AND n > 0")
    tags = F.array_compact(F.array(*[F.when(f, F.lit(p)) for p, f in _flags(as_of).items()]))
    return parts.select(F.explode(tags).alias("period"), "payment_method", "amount").groupBy("period", "payment_method").agg(F.sum("amount").cast(SUMMED).alias("total"))


def therapist_period_stats(spark: SparkSession, t: dict[str, DataFrame], path: str, as_of) -> DataFrame:
    """T2 from the summary: week, month and year to date have no upper bound, today ends with the day."""
    day = F.lit(today(as_of))
    flags = {"today": F.col("_day") == day} | {p: F.col("_day") >= F.lit(period_starts(as_of)[s].date()) for p, s in (("week", "week"), ("month", "month"), ("ytd", "year"))}
    parts = _parts(spark, t, path, as_of, "items", open_end=True).where("done AND n > 0")
    sums = parts.groupBy("eid").agg(*[a for p, f in flags.items() for a in (F.sum(F.when(f, F.col("n"))).alias(f"{p}_count"), F.sum(F.when(f, F.col("net"))).alias(f"{p}_revenue"))])
    out = t["employees"].select("eid").join(sums, "eid", "left")
    return out.select("eid", *[c for p in flags for c in (F.coalesce(f"{p}_count", F.lit(0)).cast("long").alias(f"{p}_count"), F.coalesce(f"{p}_revenue", F.lit(0)).cast(SUMMED).alias(f"{p}_revenue"))])
