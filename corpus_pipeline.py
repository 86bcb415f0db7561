"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all documents that the
stage before kept, and returns a DataFrame that is written as Parquet and read again for the next. All but the
last return the columns of documents. Every stage takes nulls in any column, empty and very long texts, repeated
rows, empty tables and extra columns as its operator states; rows with a null doc_id stay unless a stage's rule
drops their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.llm.common import table, written
from parlour.llm.decontaminate import contaminated
from parlour.llm.exact_dedup import exact_dedup
from parlour.llm.packing import pack
from parlour.llm.quality_crf import quality_scores
from parlour.llm.queries import QUALITY_THRESHOLD, quality_model
from parlour.llm.simhash import near_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. The model is that of op5, fitted on the labels' training rows."""
    name = _unused(docs, "score")
    return quality_scores(docs, quality_model(spark, sf_dir), score_col=name).filter(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    name = _unused(docs, "dedup")
    return exact_dedup(docs, keep="max", carry=True, result_col=name).filter(F.col(name)["kept"]).drop(name)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id."""
    return near_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct(), "pipeline-leaks")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (key == found["text_key"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: Scores, fingerprints and token ids have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
