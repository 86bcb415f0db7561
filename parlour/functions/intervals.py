"""Interval-overlap joins with a time-bucket key.

Spark has no interval join; an overlap predicate alone is a nested loop. Both sides are
exploded into the day buckets they touch and joined on ``keys + day`` with the overlap as a
residual, so a hot key (one customer, therapist or room with a third of all bookings) is
spread over its days. Each matching pair is kept only in the bucket where the overlap
begins, so no pair is emitted twice and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlour.functions.temporal import overlaps, ts_lit

#: Seconds of a bucket, by level: an hour, a day, 32 days, some 3 years, some 90 years.
LEVELS = (3600, 86400, 32 * 86400, 1024 * 86400, 32768 * 86400)


def day_buckets(start: Column, end: Column) -> Column:
    """The days an interval [start, end) touches, as an array of DATE. An inverted interval (end before
    start, bad data that Q1 reports) touches the days between; it overlaps what lies around both ends."""
    a, b = F.to_date(start), F.to_date(end)
    return F.sequence(F.least(a, b), F.greatest(a, b), F.expr("INTERVAL 1 DAY"))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str],
                  r_span: tuple[str, str], extra: Column | None = None) -> DataFrame:
    """Inner join of ``left`` and ``right`` on ``keys`` where ``l_span`` overlaps ``r_span``
    (open: l_start < r_end and l_end > r_start). Column names must not clash except ``keys``.
    Rows with a NULL bound never match (as in SQL)."""
    ls, le = l_span
    rs, re_ = r_span
    lx = left.where(F.col(ls).isNotNull() & F.col(le).isNotNull()).withColumn(
        "_day", F.explode(day_buckets(F.col(ls), F.col(le))))
    rx = right.where(F.col(rs).isNotNull() & F.col(re_).isNotNull()).withColumn(
        "_day", F.explode(day_buckets(F.col(rs), F.col(re_))))
    cond = overlaps(F.col(rs), F.col(re_), F.col(ls), F.col(le))
    first_day = F.to_date(F.greatest(F.col(ls), F.col(rs))) == F.col("_day")
    if extra is not None:
        cond = cond & extra
    return lx.join(rx, keys + ["_day"]).where(cond & first_day).drop("_day")


def level_buckets(start: Column, end: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """Array of (level, bucket, home) of an interval: the buckets it touches on its home level, the lowest whose
    buckets are as long as it is, and on every level above. At most two a level, however long it is (on the top level
    one more for each 90 years)."""
    sec = lambda c: F.timestamp_diff("SECOND", ts_lit("1970-01-01"), c)
    lo, hi = sec(F.least(start, end)), sec(F.greatest(start, end))
    none = F.array().cast("array<struct<level:int,bucket:bigint,home:boolean>>")

    def touched(level: int, home: Column) -> Column:
        size = levels[level]
        return F.transform(F.sequence(F.floor(lo / size), F.floor(hi / size)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket"), home.alias("home")))

    parts = []
    for level, size in enumerate(levels):
        lower = F.lit(False) if level == 0 else hi - lo <= levels[level - 1]
        if level + 1 == len(levels):
            parts.append(touched(level, ~lower))
        else:
            parts.append(F.when(hi - lo <= size, touched(level, ~lower)).otherwise(none))
    return F.flatten(F.array(*parts))


def time_overlap_pairs(left: DataFrame, right: DataFrame, l_span: tuple[str, str], r_span: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """As ``overlap_pairs``, also without any key: a pair meets on the home level of the longer interval, once.

    Rows on their home level look for partners of that level or below (side 0 if the left one is at home, side 1 if
    only the right one is), so that two intervals which merely share a coarse bucket never meet there. A busy day is
    dealt over its hours, and a long interval is a few rows."""
    (ls, le), (rs, re_) = l_span, r_span
    keys = list(keys or [])
    given = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_b", F.explode(level_buckets(F.col(a), F.col(b))))
    lx = given(left, ls, le).withColumn("_side", F.when(F.col("_b.home"), 0).otherwise(1))
    rx = given(right, rs, re_).withColumn("_side", F.explode(F.when(F.col("_b.home"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    meet = [F.col("_b.level").alias("_level"), F.col("_b.bucket").alias("_bucket")]
    lx, rx = lx.select(*left.columns, "_side", *meet), rx.select(*right.columns, "_side", *meet)
    begin = F.timestamp_diff("SECOND", ts_lit("1970-01-01"), F.greatest(F.col(ls), F.col(rs)))
    size = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_level") + 1)
    once = F.floor(begin / size) == F.col("_bucket")
    return (lx.join(rx, [*keys, "_side", "_level", "_bucket"])
            .where(overlaps(F.col(rs), F.col(re_), F.col(ls), F.col(le)) & once).drop("_side", "_level", "_bucket"))


def envelope_filter(df: DataFrame, start: str, end: str, requests: DataFrame, r_start: str, r_end: str) -> DataFrame:
    """Keep rows of ``df`` whose [start, end) can overlap some request: a one-row aggregate of
    the requests' time span is broadcast and used as a range filter before any shuffle."""
    env = requests.agg(F.min(r_start).alias("_lo"), F.max(r_end).alias("_hi"))
    return df.crossJoin(F.broadcast(env)).where((F.col(start) < F.col("_hi")) & (F.col(end) > F.col("_lo"))).drop(
        "_lo", "_hi")
