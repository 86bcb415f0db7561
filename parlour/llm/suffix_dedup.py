"""Operator 2: removal of repeated byte strings by prefix doubling.

A position's rank is the name of the 2**k bytes that begin there; the pair of names at i and i + 2**k is the
next name. Names are 64-bit hashes, so that equal strings get equal names in any task and the first rounds
(offsets 1 to 64) need no exchange. Spark then ranks positions in three rounds and drops what is unique:

1. at 64 bytes. Of the 137 positions at which a 64-byte string can lie within a 200-byte window, the window is
   represented by the one with the least name (the leftmost of equals). Equal windows choose the same one, so
   these positions, about one in 70, stand for all. A run of windows with one representative is one row.
2. at the run: the names of all bytes that its windows cover. A run whose span occurs again is repeated whole.
3. at 200 bytes, for the windows of runs that share their 64 bytes but not their span: at the ends of repeats.
   The bytes of these runs (a few hundred each) are brought together by their 64-byte name.

Ranking every position instead would exchange 8 to 16 bytes for each byte of text in every round.

Scale: rounds 1 and 2 are aggregates with map-side combination (equal names of a task are sent once) and one
join in which Spark splits skewed names; a name that a third of all documents share stays one row of the
table of names. No group is gathered: documents get back only their own repeated intervals. Text is shuffled
by document for round 3 and for the removal, but for texts that a Bloom filter of fixed size says have no part in it.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlour.llm.bloom import may_hold, members
from parlour.llm.common import n_partitions, written

TOGETHER = 20_000  # runs of one name that are compared in one task, at most (about 6 MB); those of other names by windows
PORTION = 2000  # runs that are compared at a time, but for those of one name, which stay together
THRESHOLD = 200  # bytes of a string that must not repeat
FIRST = 64  # bytes of the first distributed round
SEGMENT = 1 << 22  # windows handled at a time; positions within fit 24 bits

_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_MULTIPLY = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _pair(a: np.ndarray, b: np.ndarray, m: np.uint64) -> np.ndarray:
    """Names of pairs of names."""
    x = a * m
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def names(data: np.ndarray, size: int) -> list[np.ndarray]:
    """Names of the strings of 64 and of 128 bytes at every position that has them (doubling offsets)."""
    v, h, out = _BYTE[data], 1, []
    for m in _MULTIPLY:
        v = _pair(v[:-h], v[h:], m) if len(v) > h else v[:0]
        h *= 2
        if h >= FIRST:
            out.append(v)
        if h >= size:
            return out
    raise ValueError(size)


def window_names(n128: np.ndarray, s: np.ndarray, threshold: int) -> np.ndarray:
    """Names of the ``threshold`` bytes at ``s``: two overlapping strings of 128."""
    return _pair(n128[s], n128[s + (threshold - 128)], _MULTIPLY[0])


def runs(data: np.ndarray, threshold: int = THRESHOLD, spans: bool = True) -> tuple[np.ndarray, ...]:
    """(name, span name, representative, first window, last window) of each run of windows of one document;
    the names alone without ``spans``."""
    n = len(data) - threshold + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    n64, *more = names(data, 128 if spans else FIRST)
    width = threshold - FIRST + 1
    rep = np.empty(n, np.int64)
    for s0 in range(0, n, SEGMENT):
        s1 = min(n, s0 + SEGMENT)
        least = n64[s0 : s1 + width - 1]
        least = (least & ~np.uint64((1 << 24) - 1)) | np.arange(len(least), dtype=np.uint64)
        h = 1
        while 2 * h <= width:
            least = np.minimum(least[:-h], least[h:])
            h *= 2
        least = np.minimum(least[: s1 - s0], least[width - h : width - h + s1 - s0])
        rep[s0:s1] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + s0
    lo = np.concatenate(([0], np.flatnonzero(rep[1:] != rep[:-1]) + 1))
    hi = np.concatenate((lo[1:] - 1, [n - 1]))
    at = rep[lo]
    if not spans:
        return (n64[at],)
    (n128,) = more
    # the span [lo, hi + threshold) is covered by strings of 128 at its start, its middle and its end
    end = hi + threshold - 128
    span = _pair(_pair(n128[lo], n128[(lo + end) >> 1], _MULTIPLY[1]), n128[end], _MULTIPLY[2])
    span = _pair(span, ((at - lo) * 1024 + (hi - lo)).astype(np.uint64), _MULTIPLY[3])
    return n64[at], span, at, lo, hi


def _run_rows(threshold: int, place: bool):
    """Rows of runs: their names, or names, spans and places. A place packs the representative, and how far
    before it the first and the last window begin."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, size = [], 0
            texts = b["text"].tolist()
            for i, t in enumerate(texts):
                got = runs(np.frombuffer(t, np.uint8), threshold, place)
                if len(got[0]):
                    parts.append((i, got))
                    size += len(got[0])
                if parts and (size > 200_000 or i + 1 == len(texts)):
                    columns = [np.concatenate(c) for c in zip(*[p[1] for p in parts])]
                    out = {"name": columns[0].view(np.int64)}
                    if place:
                        _, span, at, lo, hi = columns
                        of = np.repeat([p[0] for p in parts], [len(p[1][0]) for p in parts])
                        out |= {"span": span.view(np.int64), "id": b["id"].take(of).array, "key": b["key"].take(of).array,
                                "place": (at << 20) | ((at - lo) << 10) | (at - hi + 512)}
                    yield pd.DataFrame(out)
                    parts, size = [], 0

    return rows


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 20
    return at, at - ((place >> 10) & 1023), at - ((place & 1023) - 512)


def _strings(threshold: int):
    """The bytes that a run's windows cover, one row a run; ``before``: how far they begin before the representative."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, k, text, todo in zip(b["id"], b["key"], b["text"], b["runs"]):
                at, lo, hi = _unpack(np.array([r["place"] for r in todo], np.int64))
                out = pd.DataFrame({c: [r[c] for r in todo] for c in ("name", "m", "many")})
                yield out.assign(id=i, key=[k] * len(out), start=lo, before=(at - lo).astype(np.int32), bytes=[text[x : y + threshold] for x, y in zip(lo.tolist(), hi.tolist())])

    return rows


def _named_windows(b: pd.DataFrame, threshold: int) -> tuple[np.ndarray, ...]:
    """For every window of the strings of ``b``: its row, its place in the row's string, and its name, made of the
    bytes and the distance to the representative."""
    size = np.fromiter(map(len, b["bytes"]), np.int64, len(b))
    n128 = names(np.frombuffer(b"".join(b["bytes"]), np.uint8), 128)[1]
    n = size - threshold + 1
    row = np.repeat(np.arange(len(b)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window = window_names(n128, (np.cumsum(size) - size)[row] + at, threshold)
    return row, at, _pair(window, (b["before"].to_numpy(np.int64)[row] - at).astype(np.uint64), _MULTIPLY[4])


def _compared(threshold: int):
    """Intervals of the runs of weight 1 whose windows occur again among the rows of their name."""

    def compared(b: pd.DataFrame) -> pd.DataFrame:
        row, at, window = _named_windows(b, threshold)
        m = b["m"].to_numpy(np.int64)[row]
        _, which = np.unique(_pair(window, b["name"].to_numpy(np.int64).view(np.uint64)[row], _MULTIPLY[6]), return_inverse=True)
        hit = (m == 1) & (np.bincount(which, m)[which] > 1)
        row, at = row[hit], at[hit]
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))[: len(row)]
        last = np.concatenate((first[1:], [True]))[: len(row)]
        start = b["start"].to_numpy(np.int64)
        return pd.DataFrame({"id": b["id"].take(row[first]).array, "key": b["key"].take(row[first]).array,
                             "start": start[row[first]] + at[first], "end": start[row[last]] + at[last] + threshold})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows sorted by name; whole names, some PORTION rows at a time
        for b in batches:
            if len(b):
                held = b if held is None else pd.concat([held, b], ignore_index=True)
                whole = held["name"].to_numpy() != held["name"].iloc[-1]
                if whole.sum() >= PORTION:
                    yield compared(held[whole].reset_index(drop=True))
                    held = held[~whole].reset_index(drop=True)
        if held is not None:
            yield compared(held)

    return rows


def _windows(threshold: int):
    """One row for each window of the strings."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                b = whole.iloc[i : i + 2000]
                row, at, window = _named_windows(b, threshold)
                yield pd.DataFrame({"name": b["name"].to_numpy()[row], "window": window.view(np.int64), "m": b["m"].to_numpy()[row], "id": b["id"].take(row).array,
                                    "key": b["key"].take(row).array, "start": b["start"].to_numpy()[row] + at})

    return rows


def with_text(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, key, text, runs) of the documents that have runs in ``wanted``; a list holds a document's own runs alone."""
    per_doc = written(wanted.groupBy("id", "key").agg(F.collect_list(F.struct("name", "place", "m", "many")).alias("runs")), "op2-runs")
    some = keyed.withColumn("h", F.xxhash64("id", "key")).filter(may_hold(members(per_doc.select(F.xxhash64("id", "key").alias("h"))))("h"))
    same = F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.key") == F.col("p.key"))
    return some.alias("t").join(per_doc.alias("p"), same).select("t.id", "t.key", "t.text", "p.runs")


def repeated_intervals(keyed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, key, start, end): byte intervals of ``keyed`` (id, key, text as bytes) that together cover exactly
    the bytes in strings of ``threshold`` bytes that start anywhere else too."""
    if not 128 <= threshold <= 256:
        raise ValueError("threshold: 128 to 256 bytes")
    id_type = dict(keyed.dtypes)["id"]
    ranks = (keyed.mapInPandas(_run_rows(threshold, False), "name long").groupBy("name").agg(F.count("*").alias("n"))
             .filter("n > 1").select("name"))
    placed = keyed.mapInPandas(_run_rows(threshold, True), f"name long, span long, id {id_type}, key binary, place long")
    met = written(placed.join(ranks, "name"), "op2-met")

    spans = written(met.groupBy("name", "span").agg(F.count("*").alias("m"), F.min(F.struct("id", "key", "place")).alias("first")), "op2-spans")
    whole = met.join(spans.filter("m > 1").select("name", "span"), ["name", "span"]).select("id", "key", "place")
    # names with a run of its own kind: its windows are compared with those of one run of every other kind
    open_names = spans.groupBy("name").agg(F.min("m").alias("least"), F.count("*").alias("kinds")).filter("least = 1 and kinds > 1").select("name")
    wanted = spans.join(open_names, "name").select("name", F.col("first.id").alias("id"), F.col("first.key").alias("key"), F.col("first.place").alias("place"), "m")
    many = spans.join(open_names, "name").groupBy("name").count().filter(F.col("count") > TOGETHER).select("name", F.lit(True).alias("many"))
    wanted = wanted.join(many, "name", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    strings = written(with_text(keyed, wanted).mapInPandas(_strings(threshold), f"name long, m long, many boolean, id {id_type}, key binary, start long, before int, bytes binary"), "op2-strings")

    # windows of names that few runs share are compared in the task that has these runs
    few = strings.filter("not many").repartition(n_partitions(keyed.sparkSession), "name").sortWithinPartitions("name").mapInPandas(_compared(threshold), f"id {id_type}, key binary, start long, end long")
    # of a name that very many runs share each window is a row: counted in part before the shuffle, then joined, where Spark splits it
    each = written(strings.filter("many").mapInPandas(_windows(threshold), f"name long, window long, m long, id {id_type}, key binary, start long"), "op2-windows")
    again = each.groupBy("name", "window").agg(F.sum("m").alias("total")).filter("total > 1").select("name", "window")
    most = each.filter("m = 1").join(again, ["name", "window"]).select("id", "key", "start", (F.col("start") + threshold).alias("end"))

    def to_intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, lo, hi = _unpack(b["place"].to_numpy(np.int64))
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "start": lo, "end": hi + threshold})

    return (whole.mapInPandas(to_intervals, f"id {id_type}, key binary, start long, end long")
            .unionByName(few).unionByName(most))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate((first[1:] - 1, [len(starts) - 1]))] if len(first) else ends[:0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, removed (array of start, end: maximal removed byte runs), kept (the
    remaining bytes, concatenated).

    A null text counts as empty: nothing removed. Rows that repeat identifier and text are texts of their own, so
    that all of a text of ``threshold`` bytes or more that occurs twice is removed from both. Null identifiers are
    carried along. An empty table gives an empty result. Other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.cast("binary").alias("text"))
    found = repeated_intervals(keyed, threshold)
    per_doc = written(found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "op2-intervals")  # at most a document's own intervals

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            removed, kept = [], []
            for text, spans in zip(b["text"], b["spans"]):
                if spans is None:
                    removed.append([])
                    kept.append(text)
                    continue
                s, e = merged(*(np.array([x[j] for x in spans], np.int64) for j in ("start", "end")))
                removed.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                bounds = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(bounds[::2], bounds[1::2])))
            yield pd.DataFrame({"doc_id": b["id"], "n_bytes": [len(t) for t in b["text"]], "removed": removed, "kept": kept})

    # texts that surely have no interval stay where they are; the others meet their intervals
    hit = may_hold(members(per_doc.select(F.xxhash64("id", "key").alias("h"))))("h")
    marked = keyed.withColumn("h", F.xxhash64("id", "key"))
    joined = marked.filter(hit).alias("t").join(per_doc.alias("p"), F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.key") == F.col("p.key")), "left")
    id_type = dict(docs.dtypes)[id_col]
    whole = marked.filter(~hit).select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"),
                                       F.array().cast("array<struct<start:long,end:long>>").alias("removed"), F.col("text").alias("kept"))
    return joined.select("t.id", "t.text", "p.spans").mapInPandas(cut, f"doc_id {id_type}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary").unionByName(whole)


def repeat_report(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ``remove_repeats``."""
    return result.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
                         F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
