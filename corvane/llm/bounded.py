"""Broadcast of tables whose size in bytes was measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 16 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        n = F.octet_length(c) + 16
    elif isinstance(kind, T.ArrayType):
        inner = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.size(c) * 8
        n = inner + 16
    else:
        n = F.lit(8)
    return F.coalesce(n, F.lit(8)).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """The bytes of all values of df, as rows hold them; 32 more for each row."""
    per = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(32))
    return df.agg(F.coalesce(F.sum(per), F.lit(0))).first()[0]


def few(df: DataFrame) -> DataFrame:
    """df, broadcast if it is measured to hold at most BROADCAST_BYTES; beyond that the same join is a shuffle.

    df should be a table that was written, or its plan runs twice."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df
