"""A Bloom filter of 64-bit hashes with a fixed number of bits, built as Spark bitmaps.

It spares rows a shuffle that cannot find a partner: what it rejects surely is not a member, what it lets pass is
joined exactly. Its size does not depend on the members; with very many of them it only rejects less."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # 2**26 bits: 8 MB
PROBES = (0, 19, 38)
PAGE = 32768  # bits of one of Spark's bitmaps


def members(hashes: DataFrame) -> Broadcast:
    """The filter of column ``h`` (long, not null): at most 2**BITS / PAGE bitmaps of 4 KB reach the driver."""
    mask = F.lit((1 << BITS) - 1)
    at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(mask) + 1 for s in PROBES]))  # bitmaps count from 1
    pages = (hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    data = np.zeros((1 << BITS) // 8, np.uint8)
    for r in pages:
        data[(r.page - 1) * PAGE // 8 : r.page * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(data)


def may_hold(bits: Broadcast):
    """Column function: whether a hash may be a member."""

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        x, data = h.to_numpy(np.int64).view(np.uint64), bits.value
        ok = np.ones(len(x), bool)
        for s in PROBES:
            at = (x >> np.uint64(s)) & np.uint64((1 << BITS) - 1)
            ok &= (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return held
