"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
the query is expressible in SQL, the DuckDB oracle statement over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlour.functions.listing import in_order
from parlour.plans.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def money_to_double(df: DataFrame) -> DataFrame:
    """Decimal money is summed exactly and turned into DOUBLE only at the very end."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return in_order(money_to_double(fn(spark, sf_dir)), name)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


def register_as(name: str, other: str):
    """Another way to the rows of the query ``other``: its oracle holds for ``name`` as well."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        register(name)(fn)
        ORACLE[name] = ORACLE[other]
        return fn

    return deco
