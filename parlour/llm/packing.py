"""Operator 9: best-fit packing by linear grouping.

Documents become token ids and pieces of at most ``capacity`` ids. The counts of piece lengths (at most
``capacity`` rows) go to the driver, where ``packing_plan`` lays out all sequences as templates; each piece is
numbered among those of its length and looks up its place in the plan.

Scale: the text is read once and never shuffled; pieces (a few numbers each) are. Numbering is a window over
(length, bucket) with the buckets' offsets from a count, so a length that a third of all pieces share is
dealt over BUCKETS tasks. The plan's places and the offsets are broadcast: their size is bounded by the
capacity (lengths x templates, lengths x BUCKETS), not by the documents. Pieces of full length need no plan.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlour.llm.common import worker_object, written
from parlour.llm.packing_plan import plan
from parlour.llm.token_ids import TokenIds

CAPACITY, END_ID, BUCKETS = 1024, 2, 64
FULL_BASE = 1 << 62  # sequence numbers of full pieces start here


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = worker_object(("token ids", tokenizer), lambda: TokenIds(tokenizer))
        for b in batches:
            out = []
            for i, ids in enumerate(ids_of.encode(b["text"].tolist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                start, end = 0, first
                while start < len(ids):
                    out.append((i, len(out), start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            row, _, start, length, crc = zip(*out) if out else ((),) * 5
            row = np.array(row, np.int64)
            piece = np.arange(len(row)) - np.searchsorted(row, row)
            yield pd.DataFrame({"id": b["id"].take(row).array, "piece": piece.astype(np.int32), "start": start, "length": length, "crc": crc})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(pieces, f"id {kind}, piece int, start long, length long, crc long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece that holds the end id alone. Repeated rows are packed as often as
    they occur; a null identifier is carried along. An empty table gives an empty result. Other columns play
    no part, whatever their names. Documents longer than ``capacity`` are cut, the first piece being the short one."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity, end_id)
                     .withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS)).cast("int")), "op9-pieces")
    short = pieces.filter(F.col("length") < capacity)
    per_bucket = short.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per_bucket = per_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    per_bucket = written(per_bucket, "op9-counts")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    places, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, lengths in plan(counts, capacity):
        offset = 0
        for length in lengths:
            places.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = spark.createDataFrame(pd.DataFrame(places, columns=["at_length", "low", "high", "first", "offset"], dtype="int64"),
                                  "at_length long, low long, high long, first long, offset long")
    numbered = (short.join(F.broadcast(per_bucket.drop("n")), ["length", "bucket"])
                .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")) - 1))
    placed = numbered.join(F.broadcast(table), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    result = [F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32")]
    full = pieces.filter(F.col("length") == capacity)
    return (placed.select(*result, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
            .unionByName(full.select(*result, (F.lit(FULL_BASE) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))))
