"""Operator 7: benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over SPAN consecutive tokens; its hash ignores the masked-out positions, so that a
substituted token spoils only the seeds that look at it. Test items' seed hashes are joined with those of all
documents; around each hit the item is laid over the document on the hit's diagonal, token by token, and the
best stretch of at most REACH tokens either side is verified: at least ``min_share`` of its tokens equal.

Scale: documents are scanned once. In the scan, seeds are tested against a Bloom filter of the items' hashes,
whose size is fixed (2**FILTER_BITS bits), so that only hits and a few false positives leave the task, each
with the tokens around it (a bounded window). The exact join of these with the items' seeds follows; one
passage that very many documents hold is first reduced to distinct windows, and items' seeds are dealt over
SEED_SALTS parts. Nothing grows on the driver but the filter, which is built from the items' hashes alone.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.llm.common import written

# Fixed masks (1: looked at) and the item lengths, in tokens, that they serve. Three of weight 8 serve all items of 8 tokens
# or more; three of weight 5 join them for short items, so that every choice of up to a fifth substituted tokens leaves a
# seed intact. Items of 3 to 7 tokens are hashed whole.
LONGEST_SHORT = 31
MASKS = (("1101100110101", 8, None), ("1011010110011", 8, None), ("11111111", 8, None),
         ("111011", 8, LONGEST_SHORT), ("11000111", 8, LONGEST_SHORT), ("1101101", 8, LONGEST_SHORT),
         *(("1" * n, n, n) for n in range(3, 8)))
SPAN = 13
REACH = 32  # tokens verified either side of a hit
MIN_SHARE = 0.8
MIN_TOKENS = 13  # of a verified stretch; an item with fewer must match whole
FILTER_BITS = 23
SEED_SALTS, SALTS = 4, 16  # parts over which items' seeds (with their tokens) and verified windows are dealt

_TOKEN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
_OFFSETS = np.random.default_rng(7).integers(1, 1 << 62, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens (runs of letters and digits, lower case), and tokens per text."""
    data = [t.lower().encode("utf-8", "replace").translate(_TOKEN) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    inside = joined != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    value = (joined[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    h = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
    text_ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) + 1
    return h, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def seed_hashes(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at every token position at which it fits."""
    m = MASKS[mask][0]
    n = len(tokens) - len(m) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, mask + 1, np.uint64)
    for j, c in enumerate(m):
        if c == "1":
            h += tokens[j : j + n] * _OFFSETS[j]
    return mix(h)


def stretch(doc: np.ndarray, item: np.ndarray, d_at: int, i_at: int, span: int) -> tuple[int, int]:
    """(equal tokens, tokens) of the best verified stretch around a hit: the item laid over the document with
    ``item[i_at]`` on ``doc[d_at]``, cut to REACH tokens either side of the seed. The whole overlap counts if it
    passes; else the longest part around the hit that begins and ends on equal tokens and passes."""
    left = min(d_at, i_at, REACH)
    right = min(len(doc) - d_at, len(item) - i_at, span + REACH)
    eq = doc[d_at - left : d_at + right] == item[i_at - left : i_at + right]
    total = np.concatenate(([0], np.cumsum(eq)))
    n = len(eq)
    best = (int(total[-1]), n)
    if best[0] >= MIN_SHARE * n:
        return best
    best = (0, 1)
    for a in np.flatnonzero(eq[: left + 1]).tolist() or [left]:
        ends = np.flatnonzero(eq[left + span - 1 :]) + left + span
        good = ends[(total[ends] - total[a]) >= MIN_SHARE * (ends - a)]
        if len(good) and good[-1] - a > best[1]:
            best = (int(total[good[-1]] - total[a]), int(good[-1] - a))
    return best


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        h, n = token_hashes(b["text"].tolist())
        ends = np.cumsum(n)
        rows = []
        for item, e, k in zip(b["item"], ends, n):
            toks = h[e - k : e]
            for m, (shape, least, most) in enumerate(MASKS):
                if least <= k <= (most or k):
                    for at, s in enumerate(seed_hashes(toks, m).view(np.int64).tolist()):
                        lo = max(0, at - REACH)
                        rows.append((s, item, at - lo, toks[lo : at + len(shape) + REACH].tobytes(), len(shape), int(k), m))
        yield pd.DataFrame(rows, columns=["seed", "item", "i_at", "i_tokens", "span", "i_n", "mask"])


class Filter:
    """Bloom filter of 64-bit hashes with three probes and a fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for s in (0, 20, 40)]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions of ``h`` that may be in the set."""
        at = np.flatnonzero(self.bits[self.places(h)[0]])
        _, p, q = self.places(h[at])
        return at[self.bits[p] & self.bits[q]]


def _filter(seeds: DataFrame) -> np.ndarray:
    """The filter's bits, gathered as set positions (at most 2**FILTER_BITS, whatever the number of items)."""

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = b["seed"].to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({"at": np.unique(np.concatenate(Filter.places(h)))})

    got = seeds.select("seed").distinct().mapInPandas(positions, "at long").distinct().toPandas()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[got["at"].to_numpy(np.int64)] = True
    return bits


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, equal_tokens, verified_tokens) for every document and item with a verified
    overlap: the stretch with the most equal tokens. ``text_key`` is the hash of the text, which tells rows of
    one identifier apart. Null texts and texts or items too short to hold a seed (under 3 tokens) never match, items of 3 to 7 tokens word for word; a null item_id
    is an item like any other; repeated rows give one result."""
    item_type = dict(benchmark.dtypes)[item_col]
    seeds = written(benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
                    .mapInPandas(_item_rows, f"seed long, item {item_type}, i_at int, i_tokens binary, span int, i_n int, mask int"), "op7-seeds")
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # those that some item has
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(seeds)))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Filter(np.unpackbits(bits.value).view(bool))
        for b in batches:
            texts = b["text"].tolist()
            for i0, i1 in _chunks(texts, 500_000):
                h, n = token_hashes(texts[i0:i1])
                ends = np.cumsum(n)
                rows = []
                for m in masks:
                    s = seed_hashes(h, m)
                    at = held.has(s)
                    doc = np.searchsorted(ends, at, "right")
                    span = len(MASKS[m][0])
                    for p, d in zip(at.tolist(), doc.tolist()):
                        lo, hi = ends[d] - n[d], ends[d]
                        if p + span <= hi:  # not across two documents
                            lo = max(lo, p - REACH)
                            rows.append((i0 + d, int(s[p].astype(np.int64)), p - lo, h[lo : min(hi, p + span + REACH)].tobytes()))
                if rows:
                    d, s, a, t = zip(*rows)
                    take = list(d)
                    yield pd.DataFrame({"id": b["id"].take(take).array, "text_key": b["text_key"].take(take).array, "seed": s, "d_at": a, "d_tokens": t})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [stretch(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), x, y, s)
                   for d, i, x, y, s in zip(b["d_tokens"], b["i_tokens"], b["d_at"], b["i_at"], b["span"])]
            eq = np.array([g[0] for g in got], np.int64)
            n = np.array([g[1] for g in got], np.int64)
            ok = (eq >= MIN_SHARE * n) & (n >= np.minimum(MIN_TOKENS, b["i_n"].to_numpy(np.int64)))
            yield pd.DataFrame({"window": b["window"], "item": b["item"], "eq": eq, "n": n})[ok]

    id_type = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = (docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
             .mapInPandas(hits, f"id {id_type}, text_key long, seed long, d_at int, d_tokens binary")
             .withColumn("window", F.xxhash64("seed", "d_at", "d_tokens")))
    found = written(found, "op7-hits")
    windows = found.groupBy("window").agg(F.first("seed").alias("seed"), F.first("d_at").alias("d_at"), F.first("d_tokens").alias("d_tokens"))
    windows = windows.withColumn("salt", F.pmod(F.col("window"), F.lit(SEED_SALTS)))
    dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEED_SALTS - 1).cast("long"))))
    # the hint: salted sides are sized from the file before the explode, and would be broadcast SEED_SALTS or SALTS times as large
    met = windows.join(dealt.hint("merge"), ["seed", "salt"]).mapInPandas(verify, f"window long, item {item_type}, eq long, n long")
    met = written(met, "op7-verified")
    spread = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    keyed = found.select("id", "text_key", "window", spread.alias("salt")).distinct()
    dealt = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return (keyed.join(dealt.hint("merge"), ["window", "salt"]).groupBy("id", "text_key", "item")
            .agg(F.max(F.struct("eq", "n")).alias("best"))
            .select(F.col("id").alias("doc_id"), "text_key", F.col("item").alias("item_id"),
                    F.col("best.eq").alias("equal_tokens"), F.col("best.n").alias("verified_tokens")))


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters (one text at least)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted list), equal_tokens (most over its items).

    An empty benchmark contaminates nothing; an empty table gives an empty result; a null identifier is reported
    and never contaminated by another row. Other columns play no part, whatever their names."""
    per_doc = (contaminated(docs, benchmark, id_col, text_col).groupBy("doc_id", "text_key")
               .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("equal_tokens").alias("equal_tokens")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    empty = F.array().cast(dict(per_doc.dtypes)["item_ids"])
    return (rows.join(per_doc, rows["id"].eqNullSafe(per_doc["doc_id"]) & (rows["key"] == per_doc["text_key"]), "left")
            .select(F.col("id").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"),
                    F.coalesce("item_ids", empty).alias("item_ids"), F.coalesce("equal_tokens", F.lit(0)).alias("equal_tokens")))
