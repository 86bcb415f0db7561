"""Load the eleven domain tables with their declared types."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from parlour.sources.schemas import SCHEMAS


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of table ``name``: order, names and types.

    A missing column fails here (AnalysisException), not later inside an operator.
    """
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


# The time column by whose month a fact table is laid out.
TIME_COLUMNS = {"transaction_items": "actual_start", "transactions": "entry_time", "payments": "payment_time"}


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", since: date | None = None, until: date | None = None,
                partitions: int | None = None, **options) -> dict[str, DataFrame]:
    """Read ``<path>/<table>.<fmt>`` for every domain table and conform it.

    A database (``fmt="jdbc"``) is read by ranges of each table's key, ``partitions`` at a time (as many as the session's
    shuffle partitions if not given); tables whose key is not a whole number are small and read whole.

    Any DataFrameReader format works (parquet, orc, json, csv, jdbc via ``options``). Column
    pruning and filter pushdown still reach the scan because ``conform`` is only a projection.
    ``since`` and ``until`` (days, both included) keep the fact rows of these months and those without a time;
    of a table that ``save_tables`` laid out by month, only these months' files are read."""
    out = {}
    for name in SCHEMAS:
        reader = spark.read.format(fmt).options(**options)
        if fmt in ("json", "csv"):
            reader = reader.schema(SCHEMAS[name])
        try:
            df = _read_database(spark, reader, name, options, partitions) if fmt == "jdbc" else reader.load(f"{path}/{name}.{fmt}")
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            df = spark.createDataFrame([], SCHEMAS[name])  # an empty table laid out by month has no files
        if name in TIME_COLUMNS:
            month = F.col("_month").cast("date") if "_month" in df.columns else _month(name)
            for day, bound in ((since, month.__ge__), (until, month.__le__)):
                if day is not None:
                    df = df.where(month.isNull() | bound(F.lit(day.replace(day=1))))
        out[name] = conform(df, name)
    return out


def key_ranges(column: str, low: int | None, high: int | None, n: int) -> list[str]:
    """At most ``n`` predicates that together hold for every value of a whole-number key (and for null) exactly once,
    cut at equal distances between ``low`` and ``high``. Rows that come in meanwhile fall into the first or last range."""
    if low is None or high is None or n <= 1 or high <= low:
        return ["1 = 1"]
    step = -(-(high - low + 1) // n)
    cuts = list(range(low + step, high + 1, step))
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def _read_database(spark: SparkSession, reader, name: str, options: dict, partitions: int | None) -> DataFrame:
    key = SCHEMAS[name][0]
    if not isinstance(key.dataType, IntegralType):
        return reader.option("dbtable", name).load()
    ends = reader.option("query", f"SELECT min({key.name}) AS low, max({key.name}) AS high FROM {name}").load().first()
    ranges = key_ranges(key.name, ends["low"], ends["high"], partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = {k: str(v) for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], name, predicates=ranges, properties=given)


def _month(name: str) -> Column:
    return F.date_trunc("MONTH", F.col(TIME_COLUMNS[name])).cast("date")


def save_tables(t: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write the domain tables as parquet (one folder per table). Facts are laid out by the month of their main
    time column, so that ``load_tables`` with ``since`` or ``until`` reads only the months asked for. Rows are
    brought together by month first (a large month is split by AQE), so that a month is a few files."""
    for name, df in t.items():
        if name in TIME_COLUMNS:
            df.withColumn("_month", _month(name)).hint("rebalance", "_month").write.mode(mode).partitionBy("_month").parquet(f"{path}/{name}.parquet")
        else:
            df.write.mode(mode).parquet(f"{path}/{name}.parquet")
