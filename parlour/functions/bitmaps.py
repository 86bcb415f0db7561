"""Sets of identifiers as bitmaps a page: which resources have an interval that overlaps a slot, without a row a pair.

A page is 4,096 neighbouring identifiers, its bitmap 64 words. Slots (a row a page) and intervals meet by page and by time
bucket; the pairs of a bucket are made and marked in memory a few million at a time, and a slot's bitmap leaves the task. What
is shuffled is the intervals, the slots a page and a bitmap a slot and page, however many pairs there are."""

from __future__ import annotations

import sys
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlour.functions.intervals import LEVELS, level_buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors need no copy of the package

PAGE, WORD = 4096, 64  # identifiers of a page and of a word of its bitmap
WORDS = PAGE // WORD
PAIRS = 2_000_000  # candidate pairs, and SLOTS bitmaps, held at a time
SLOTS = 1024


def page_of(key: Column) -> Column:
    return F.floor(key / PAGE)


def is_set(words: Column, key: Column) -> Column:
    """Whether the bit of ``key`` is set in its page's ``words``; a null bitmap is empty."""
    word = F.coalesce(F.get(words, F.shiftright(key.bitwiseAND(F.lit(PAGE - 1)), WORD.bit_length() - 1).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, key.bitwiseAND(F.lit(WORD - 1)).cast("int")).bitwiseAND(F.lit(1)) == 1


def merged(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """``rows`` with one bitmap for each of ``keys``: all that any of its bitmaps holds."""
    each = [f"_w{i}" for i in range(WORDS)]
    return (rows.groupBy(*keys).agg(*[F.bit_or(F.get(words, F.lit(i))).alias(w) for i, w in enumerate(each)])
            .select(*keys, F.array(*each).alias(words)))


def member_sets(resources: DataFrame) -> DataFrame:
    """(cls, page, members): the identifiers of ``resources`` (cls, key) as a bitmap a class and page."""
    key = F.col("key").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(WORD)).cast("int"))
    words = (resources.where(F.col("key").isNotNull())
             .groupBy("cls", page_of(key).alias("page"), F.floor(F.pmod(key, F.lit(PAGE)) / WORD).alias("word")).agg(F.bit_or(bit).alias("bits")))
    held = words.groupBy("cls", "page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    of_word = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    return held.select("cls", "page", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long")), of_word).alias("members"))


def overlapping_sets(slots: DataFrame, items: DataFrame, name: str = "busy") -> DataFrame:
    """(slot_start, slot_end, page, ``name``): for each of ``slots`` (slot_start, slot_end, page) the keys of ``items`` (key, start,
    end) of that page with an interval that overlaps the slot (both open), as a bitmap; slots without any have no row.

    As in ``time_overlap_pairs`` a pair meets on the home level of the longer interval, days being the shortest buckets; a row
    with a null bound never meets another."""
    levels = LEVELS[1:]
    given = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_b", F.explode(level_buckets(F.col(a), F.col(b), levels)))
    home, level = F.col("_b.home"), F.col("_b.level")
    meet = [level.alias("_level"), F.col("_b.bucket").alias("_bucket"), "page"]
    # side 0: the slot is at home, the item on its level or below; side 1: the item alone is. No slot lies below the lowest level,
    # and above the longest slot's level none is at home
    top = slots.agg(F.max(F.aggregate(level_buckets(F.col("slot_start"), F.col("slot_end"), levels), F.lit(0),
                                      lambda m, b: F.when(b["home"], F.greatest(m, b["level"])).otherwise(m))).alias("_top"))
    ours = given(slots.select("slot_start", "slot_end", "page").distinct(), "slot_start", "slot_end").select(
        F.when(home, 0).otherwise(1).alias("_side"), *meet, F.col("slot_start").alias("s"), F.col("slot_end").alias("e"), F.lit(-1).alias("at"))
    key = F.col("key").cast("long")
    theirs = given(items.where(F.col("key").isNotNull()), "start", "end").crossJoin(F.broadcast(top)).withColumn("page", page_of(key))
    sides = F.array_compact(F.array(F.when(level <= F.col("_top"), F.lit(0)), F.when(home & (level > 0), F.lit(1))))
    theirs = theirs.select(F.explode(sides).alias("_side"), *meet, F.col("start").alias("s"), F.col("end").alias("e"), F.pmod(key, F.lit(PAGE)).cast("int").alias("at"))
    met = ours.unionByName(theirs)
    group = ["_side", "_level", "_bucket", "page"]
    found = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(_marked, "slot_start timestamp_ntz, slot_end timestamp_ntz, page long, words array<bigint>")
    return merged(found, ["slot_start", "slot_end", "page"], "words").withColumnRenamed("words", name)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of the slots of each group of rows; a group's rows follow one another, over any number of batches."""
    rest: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        if rest and any(c[0] != r[-1] for c, r in zip(cols[:4], rest[-1])):
            yield from _of_group(rest)
            rest = []
        edges = np.flatnonzero(new).tolist()
        for lo, hi in zip([0, *edges], edges):
            yield from _of_group([*rest, [c[lo:hi] for c in cols]])
            rest = []
        rest.append([c[edges[-1] if edges else 0 :] for c in cols])
    if rest:
        yield from _of_group(rest)


def _of_group(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    s, e, at = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    slot = at < 0
    if slot.all() or not slot.any():
        return
    page, begin, end = parts[0][3][0], s[slot], e[slot]
    order = np.argsort(s[~slot], kind="stable")
    s, e, at = s[~slot][order], e[~slot][order], at[~slot][order]
    low = np.searchsorted(s, begin - (e - s).max(), "right")  # of those that begin earlier none reaches the slot
    n = np.maximum(np.searchsorted(s, end, "left") - low, 0)
    total = np.concatenate(([0], np.cumsum(n)))
    k = 0
    while k < len(n):
        to = max(k + 1, min(k + SLOTS, int(np.searchsorted(total, total[k] + PAIRS, "right")) - 1))
        m = n[k:to]
        row = np.repeat(np.arange(to - k), m)
        of = np.arange(total[to] - total[k]) + np.repeat(low[k:to] - (total[k:to] - total[k]), m)
        ok = e[of] > begin[k:to][row]
        bits = np.zeros((to - k, PAGE), bool)
        bits[row[ok], at[of[ok]]] = True
        some = np.flatnonzero(bits.any(1))
        if len(some):
            words = np.packbits(bits[some], axis=1, bitorder="little").view("<i8")
            time = lambda x: pa.array(x[k:to][some], pa.int64()).cast(pa.timestamp("us"))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([time(begin), time(end), pa.array(np.full(len(some), page, np.int64)), _lists(words)], ["slot_start", "slot_end", "page", "words"])
        k = to


def _lists(words: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, WORDS, dtype=np.int32)), pa.array(words.ravel()))


def _words(column: pa.Array) -> np.ndarray:
    """A row of words each; a null bitmap is empty."""
    out = np.zeros((len(column), WORDS), np.int64)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
    return out


def listed_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, page, n_free, free of ``sets`` (keys, page, members, busy): the members that are not busy, ascending and joined
    by commas, and their number."""
    kind = dict(sets.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # a row's list may be some 40 kB
                b = whole.slice(at, 256)
                free = _words(b.column("members")) & ~_words(b.column("busy"))
                bits = np.unpackbits(free.view(np.uint8), axis=1, bitorder="little").view(bool)
                text = []
                for page, bit in zip(b.column("page").to_pylist(), bits):
                    if page != held:
                        held, names = page, np.array([str(page * PAGE + i) for i in range(PAGE)], object)
                    text.append(",".join(names[bit].tolist()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "page"]), pa.array(bits.sum(1, dtype=np.int64)), pa.array(text, pa.string())],
                                                 [*keys, "page", "n_free", "free"])

    schema = ", ".join(f"{c} {kind[c]}" for c in [*keys, "page"]) + ", n_free long, free string"
    return sets.select(*keys, "page", "members", "busy").mapInArrow(rows, schema)
