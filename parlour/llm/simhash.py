"""Operator 1: SimHash near-dedup by segment-popcount embedding and a grid range-join.

A fingerprint is mapped to the bit counts of its 2-bit segments, 16 for each half of its 64 bits. Two
fingerprints at Hamming distance d have popcount vectors at Manhattan distance at most d, and of the two
halves one differs by at most d // 2. The vectors of a half are points of an integer grid: each fingerprint
is listed in its own cell and looks into that cell and all cells at Manhattan distance <= d // 2, so that
every pair within d meets in some cell. A meeting pair passes the Manhattan bound over all 32 segments and
is then verified exactly (popcount of the xor).

Scale: equal fingerprints are one point, so groups of copies never pair up; a link is emitted by the lower
half alone if both halves meet. A cell key has about 22 bits of selectivity, 33 look-ups a half for d = 3.
The text never leaves its scan task: 16 bytes a document are shuffled, then cells of distinct fingerprints.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlour.llm.common import written
from parlour.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint_signed(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash as a signed long. A-Z lower-cased; words are runs without space or tab..CR."""
    ws = text.encode("utf-8", "replace").translate(_LOWER).split(b" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    data = b" ".join(ws)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return int(np.uint64(digest(data, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    by_byte = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 96:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:  # bits of a byte column follow from how often each of its 256 values occurs
        ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """(row: all columns of docs as a struct, fp: signed long). A null text has fingerprint zero, like an empty one."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_signed(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fp(F.coalesce(F.col(text_col), F.lit(""))).alias(name))


_PAIRS = 0x5555555555555555


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments (0, 1 or 2), packed two bits each in a long."""
    x, y = fp.bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))


def manhattan(p: Column, q: Column) -> Column:
    """Manhattan distance of two packed popcount vectors: a segment differs by |p - q| in 0..2. Counted as the
    bits of the xor of the segments' unary codes (0 -> 00, 1 -> 01, 2 -> 11)."""
    unary = lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(_PAIRS)))
    return F.bit_count(unary(p).bitwiseXOR(unary(q)))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints (column fp) at ``max_bits`` or fewer differing bits, each once."""
    reach = max_bits // 2
    if reach > 1:
        raise ValueError("the grid looks one step around a cell: max_bits is at most 3")
    low_half = (1 << 32) - 1
    points = fps.select("fp", popcounts(F.col("fp")).alias("pc"))
    cells = F.array(F.struct(F.lit(0).alias("half"), F.col("pc").bitwiseAND(F.lit(low_half)).alias("cell")),
                    F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("pc", 32).alias("cell")))
    own = points.select("fp", "pc", F.explode(cells).alias("at")).select("fp", "pc", "at.half", "at.cell")
    # a step that would leave 0..2 in its segment names no cell: it is dropped, so that none is looked up twice
    cell, steps = F.col("cell"), [F.col("cell")]
    for j in range(16 * reach):
        value = F.shiftrightunsigned("cell", 2 * j).bitwiseAND(F.lit(3))
        steps += [F.when(value < 2, cell + F.lit(1 << (2 * j))), F.when(value > 0, cell - F.lit(1 << (2 * j)))]
    probes = own.select("fp", "pc", "half", F.explode(F.array_compact(F.array(*steps))).alias("cell"))
    # sides are sized from the points' file, not from what is exploded: without the hint a few MB of points are broadcast as 66 rows each
    a, b = probes.alias("a").hint("merge"), own.alias("b")
    met = a.join(b, [F.col("a.half") == F.col("b.half"), F.col("a.cell") == F.col("b.cell"), F.col("a.fp") < F.col("b.fp"),
                     manhattan(F.col("a.pc"), F.col("b.pc")) <= max_bits,
                     F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits])
    low = manhattan(F.col("a.pc").bitwiseAND(F.lit(low_half)), F.col("b.pc").bitwiseAND(F.lit(low_half)))
    return met.filter((F.col("a.half") == 0) | (low > reach)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_classes(ids: DataFrame, max_bits: int = MAX_BITS, keep: str = "min") -> DataFrame:
    """(fp, component_id, n_rows) for every fingerprint of ``ids`` (id, fp): the smallest (or largest) identifier
    of its component. Null identifiers lose against any other; a component without any has a null id."""
    best = F.min if keep == "min" else F.max
    points = written(ids.groupBy("fp").agg(best("id").alias("best"), F.count("*").alias("n")), "op1-points")
    roots = components(near_links(points, max_bits))
    joined = points.join(roots, points["fp"] == roots["node"], "left").select(
        points["fp"], "best", "n", F.coalesce("root", points["fp"]).alias("root"))
    joined = written(joined, "op1-roots")
    linked = joined.groupBy("root").agg(best("best").alias("component_id"), F.sum("n").alias("component_size"))
    return joined.join(linked, "root").select("fp", "component_id", "component_size")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable
    over links of ``max_bits`` or fewer differing bits, its own included), component_size.

    A null or empty text has fingerprint zero and links like any other. A null identifier is reported with the
    component of its text. Repeated rows share a fingerprint. An empty table gives an empty result. Other columns
    play no part, whatever their names."""
    ids = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle)
                  .select("row.id", "fp"), "op1-ids")
    return (spread_join(ids, near_classes(ids, max_bits))
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"))


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay if one of each component does: the one with the smallest identifier, of
    rows that repeat it the one with the smallest text hash. Null identifiers lose against any other; of equal
    rows one stays; an empty table stays empty."""
    rows = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle)
    key = lambda t: F.xxhash64(F.coalesce(t, F.lit("")))
    ids = written(rows.select(F.struct(F.col("row.id").isNull().alias("none"), "row.id", key(F.col("row.text")).alias("key")).alias("id"), "fp"), "op1-ids")
    chosen = near_classes(ids, max_bits).select(F.struct("component_id.id", "component_id.key").alias("k")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.struct(F.col(id_col).alias("id"), key(F.col(text_col)).alias("key")).alias("k"))
    return held.join(chosen, "k").dropDuplicates(["k"]).select("row.*")


SALTS = 64


def spread_join(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the class of their fingerprint. One fingerprint may hold a third of all rows, so rows are dealt
    over SALTS parts by their identifier and only the parts that occur are listed for each fingerprint."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = rows.groupBy("fp", "salt").agg(F.count("*").alias("part_n")).join(classes, "fp").drop("part_n")
    return rows.join(parts, ["fp", "salt"]).drop("salt")
