"""Encode result rows as JSON text the way the reference's cache serialiser does:
decimals as numbers, dates and timestamps as ISO strings, NULLs kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(kind: T.DataType) -> bool:
    """No decimal, date or time anywhere in the type."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return _plain(kind.valueType)
    return not isinstance(kind, (T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType))


def _time_text(c: Column) -> Column:
    """A time as ISO text. Most times are whole seconds: their pattern has no fraction, which else has to be cut off again."""
    with_fraction = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    return F.when(F.date_trunc("second", c) == c, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(with_fraction)


def _ready(c: Column, kind: T.DataType) -> Column:
    """``c`` with decimals as doubles, dates and times as ISO text (microseconds if there are any), also inside
    structs, arrays and map values."""
    if _plain(kind):
        return c
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = _time_text(c)
        return text if isinstance(kind, T.TimestampNTZType) else F.concat(text, F.date_format(c, "xxx"))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ready(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ready(x, kind.elementType))
    return F.transform_values(c, lambda _, v: _ready(v, kind.valueType))


def json_ready(df: DataFrame) -> DataFrame:
    return df.select([_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the nested ``columns`` as JSON text."""
    return df.select(*[F.to_json(_ready(F.col(c), df.schema[c].dataType), {"ignoreNullFields": "false"}).alias(c) if c in columns else F.col(c) for c in df.columns])


def json_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON object per row (column ``json``), optionally next to a key column."""
    r = json_ready(df)
    return r.select(*([key] if key else []),
                    F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: newline-delimited JSON files, one part per partition."""
    json_ready(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
