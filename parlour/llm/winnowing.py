"""Operator 13 (native): document fingerprints by winnowing.

A text's words (runs of characters other than white space) give rolling K-gram hashes; of every WINDOW neighbouring
grams the one of least hash is chosen, the rightmost of equal ones, and kept with its position. Two texts that share
K + WINDOW - 1 words in a row share a whole window and hence a fingerprint; what two texts share in less than K words
gives none. Texts of fewer than K words have one gram of all of them.

Scale: all of it is array functions on one text. For the neighbouring document, rows are dealt by sampled splitters
into ranges of descending identifier, in one shuffle of the text, and each range's first row is sent to the range
before it as well; the splitters and the first keys (one a range) are all that reaches the driver.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlour.llm.common import n_partitions

K, WINDOW = 5, 8  # words of a gram, grams of a window
SAMPLES = 64  # sampled keys a range
_PLACE = 30  # bits of a place, under the hash
_LONGEST = 1 << 30  # more than any array has


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _over(values: Column, span: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place, ``combine`` over the ``span`` values from there on, by doubling; at least ``span`` values are given."""
    def longer(v: Column, have: int) -> Column:
        if have == span:
            return v
        step = min(have, span - have)  # the last step overlaps
        return _let(F.zip_with(v, F.slice(v, 1 + step, F.lit(_LONGEST)), combine), lambda w: longer(w, have + step))

    return F.slice(longer(values, 1), F.lit(1), F.size(values) - (span - 1))


def gram_hashes(text: Column, k: int = K) -> Column:
    """The hashes of all runs of ``k`` words; of all words together where there are fewer, none without words."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))
    grams = lambda h: F.when(F.size(h) >= k, _over(h, k, lambda a, b: F.xxhash64(a, b))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(h)
    return _let(F.transform(words, lambda s: F.xxhash64(s)), grams)


def chosen(hashes: Column, window: int = WINDOW) -> Column:
    """Array of (pos, hash): the grams that winnowing keeps, in order of position. A hash is the upper 34 bits of the gram's;
    below it stands the place counted from the end, so that of equal hashes the rightmost is least."""
    top = (1 << _PLACE) - 1

    def winnowed(h: Column) -> Column:
        keys = F.transform(F.reverse(h), lambda x, i: x.bitwiseAND(F.lit(-1 - top)).bitwiseOR(i))
        least = lambda v: F.when(F.size(v) >= window, F.array_distinct(_over(v, window, lambda a, b: F.least(a, b)))).when(
            F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)
        pos = lambda v: (F.size(h) - 1 - v.bitwiseAND(F.lit(top))).cast("int")
        return F.transform(F.reverse(_let(keys, least)), lambda v: F.struct(pos(v).alias("pos"), F.shiftright(v, _PLACE).alias("hash")))

    return _let(hashes, winnowed)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    return chosen(gram_hashes(text, k), window)


def fingerprint_text(marks: Column) -> Column:
    """position:hash of all marks, by position, with spaces between."""
    return F.array_join(F.transform(marks, lambda m: F.concat(m["pos"].cast("string"), F.lit(":"), F.lower(F.hex(m["hash"].bitwiseAND(F.lit((1 << (64 - _PLACE)) - 1)))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of the distinct hashes in either fingerprint the share that is in both; two without any are alike."""
    def shared(n: Column) -> Column:
        total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n
        return F.when(total > 0, n / total).otherwise(F.lit(1.0))

    return _let(F.size(F.array_intersect(a, b)), shared)


def with_next_text(docs: DataFrame, id_col: str, text_col: str, **derived: Callable[[Column], Column]) -> DataFrame:
    """(id, text, *derived, next): ``next`` has text and derived columns of the document that follows by descending
    identifier (nulls last, then by descending hash and text); after the last comes the first."""
    spark = docs.sparkSession
    n, rows = n_partitions(spark), docs.count()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.struct("id", F.xxhash64("text").alias("h")))
    kind = src.schema["key"].dataType
    sample = sorted((r["key"] for r in src.sample(min(1.0, SAMPLES * n / max(rows, 1)), seed=1).select("key").collect()),
                    key=lambda k: (k["id"] is not None, k["id"], k["h"]) if k["id"] is not None else (False, 0, k["h"]))
    splits = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    literal = F.from_json(F.lit(json.dumps([{"id": s["id"], "h": s["h"]} for s in splits], default=str)), f"array<{kind.simpleString()}>")
    src = src.withColumn("pid", F.size(F.filter(literal, lambda s: s > F.col("key"))))

    firsts = src.groupBy("pid").agg(F.max("key").alias("first")).orderBy("pid").collect()  # a row a range
    edges = spark.createDataFrame([(r["pid"], r["first"], firsts[i - 1]["pid"]) for i, r in enumerate(firsts)], f"pid int, first {kind.simpleString()}, to int")
    own, sent = F.struct("pid", F.lit(0).alias("copy")), F.struct(F.col("to").alias("pid"), F.lit(1).alias("copy"))
    dealt = (src.join(F.broadcast(edges), "pid").withColumn("at", F.explode(F.when(F.col("key").eqNullSafe(F.col("first")), F.array(own, sent)).otherwise(F.array(own))))
             .select("at.pid", "at.copy", "key", "text").repartition(n, "pid"))
    dealt = dealt.select("*", *[f(F.col("text")).alias(name) for name, f in derived.items()])
    order = Window.partitionBy("pid").orderBy("copy", F.col("key").desc_nulls_last(), F.col("text").desc())
    out = dealt.withColumn("next", F.lead(F.struct("text", *derived)).over(order)).filter("copy = 0")
    return out.select(F.col("key.id").alias("id"), "text", *derived, "next")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, marks, edited, edited_marks, next_marks): fingerprints of each text, of its edited text (the last third of its
    characters, rounded down, replaced by the first as many, or all, of the next document's) and of the next document.

    The next document is that of the next smaller identifier; a null identifier comes last, and rows of one identifier follow one
    another by descending text hash. Repeated rows follow one another. A null text is empty; a text without words has no marks. A
    single document follows itself; an empty table gives an empty result. Other columns play no part, whatever their names."""
    both = with_next_text(docs, id_col, text_col, marks=lambda t: fingerprint(t, k, window))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    both = both.select(F.col("id").alias("doc_id"), "text", "marks", edited.alias("edited"), F.col("next.marks").alias("next_marks"))
    return both.withColumn("edited_marks", fingerprint(F.col("edited"), k, window))


def fingerprint_report(found: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    of = lambda c: F.col(c)["hash"]
    return found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                        fingerprint_text(F.col("marks")).alias("fingerprint"), fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
                        likeness(of("marks"), of("edited_marks")).alias("near_edited"), likeness(of("marks"), of("next_marks")).alias("near_next"))
