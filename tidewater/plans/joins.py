"""Joins whose strategy depends on a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes that a broadcast table may have at most, as measured here; beyond that Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20
#: What a row costs beside its values, and a value of fixed size.
_ROW, _VALUE = 16, 8


def _bytes(field: T.StructField) -> Column:
    """Bytes of a column's value; those of nested ones by their number of values."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return _VALUE + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return _VALUE + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return F.lit(_VALUE)


def measured_bytes(df: DataFrame) -> int:
    """About what the rows of ``df`` take in memory."""
    row = sum((_bytes(f) for f in df.schema.fields), F.lit(_ROW))
    return df.agg(F.sum(row.cast("long"))).head()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if ``df`` has ``limit`` bytes at most, else leave it to Spark.

    ``df`` is read for that, so pass a table that is already written.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
