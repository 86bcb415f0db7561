"""Join helpers: pattern search by an inverted index, top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(text: Column) -> Column:
    """'' and the distinct characters and pairs of neighbouring characters of ``text``."""
    n = F.char_length(text)
    at = lambda size: F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit("")), F.transform(at(1), lambda i: F.substring(text, i, F.lit(1))),
                    F.transform(at(2), lambda i: F.substring(text, i, F.lit(2))))


BITS = 1 << 15  # of the filter of asked grams: 4 KB, whatever the number of terms


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _bits(grams: DataFrame) -> DataFrame:
    """One row: a filter of BITS bits, as 64-bit words, of the column ``_gram``."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(64)).cast("int"))
    words = grams.select(_place(F.col("_gram")).alias("_at")).groupBy(F.floor(F.col("_at") / 64).alias("_w")).agg(F.bit_or(one).alias("_b"))
    held = words.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
    return held.select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BITS // 64 - 1).cast("long")),
                                   lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_bits"))


def _listed(rows: DataFrame, keys: Column, grams: DataFrame) -> DataFrame:
    """``rows`` once for each of their ``keys`` that ``grams`` (_gram) may hold: the others are dropped before the rows multiply."""
    def may_hold(g: Column) -> Column:
        at = _place(g)
        return F.call_function("shiftrightunsigned", F.get("_bits", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    some = rows.crossJoin(F.broadcast(_bits(grams)))
    return some.withColumn("_gram", F.explode(F.filter(keys, may_hold))).drop("_bits")


def pattern_join(rows: DataFrame, columns: list[str], terms: DataFrame, pattern: str) -> DataFrame:
    """Rows joined with the terms whose ILIKE ``pattern`` matches one of ``columns``.

    A pattern spells out pairs of neighbouring characters (else single ones, else nothing, ''). Counts of the rows that
    hold each asked pair tell every pattern its rarest one; rows are listed under these alone, joined with the patterns
    on equality, and the pattern is checked in full. So what multiplies is bounded by the rarest pairs asked for, whatever
    the sizes. A pattern of wildcards alone asks for '', under which every row is listed. A pair (row, term) appears once."""
    keys = F.array_distinct(F.concat(*[_grams(F.lower(F.coalesce(c, F.lit("")))) for c in columns]))
    # a backslash before an ordinary character stands for that character
    asked = terms.withColumn(pattern, F.regexp_replace(pattern, r"\\([^%_\\])", "$1"))
    p = F.lower(pattern)
    pairs, singles = (F.regexp_extract_all(p, F.lit(f"(?=([^%_\\\\]{{{n}}}))"), F.lit(1)) for n in (2, 1))
    grams = F.when(F.size(pairs) > 0, pairs).when(F.size(singles) > 0, singles).otherwise(F.array(F.lit("")))
    spelled = asked.select(F.col(pattern).alias("_pattern"), F.explode(grams).alias("_gram")).where(F.col("_pattern").isNotNull()).distinct()
    counts = _listed(rows.select(*columns), keys, spelled).groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (spelled.join(counts, "_gram", "left").groupBy("_pattern")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")).select("_pattern", "_r._gram"))
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.ilike(F.col(c), F.col(pattern)), F.lit(False))
    chosen = asked.join(rarest, F.col(pattern) == F.col("_pattern")).drop("_pattern")
    return _listed(rows, keys, rarest).join(chosen, "_gram").where(match).drop("_gram")


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int, rank_col: str = "rn") -> DataFrame:
    """First ``k`` rows per group. ``order`` must be a total order (end with a unique key).

    Spark plans ``row_number() <= k`` with a WindowGroupLimit below the shuffle, so each task
    keeps at most ``k`` rows per group before exchanging: a hot group does not reach one task
    whole.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= k)
