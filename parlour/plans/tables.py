"""The fixed as-of instant of the test fixtures and a per-session cache of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlour.sources.fixtures import AS_OF, derive_tables  # noqa: F401


_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The eleven domain tables derived (lazily) from the driver tables in ``sf_dir``.

    DataFrames are immutable plans, so one set per session and folder is built and shared by
    every query (building them is Python/JVM analysis work, not data work)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = derive_tables(spark, sf_dir)
    return dict(_CACHE[key])
