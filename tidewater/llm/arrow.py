"""Small helpers for functions that map Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at a time; what a task holds beyond its batch grows with this, not with the data.
CHUNK_BYTES = 2_000_000
#: Bytes of a batch between Spark and a Python worker; Spark's own limit is 64 MB, which each side holds more than once.
BATCH_BYTES = 4_000_000
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of a batch to ``BATCH_BYTES``, so a task's memory doesn't depend on row lengths."""
    now = spark.conf.get(_SETTING, None)
    if now is not None and now != str(BATCH_BYTES):
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``most`` text bytes; a longer text comes alone."""
    for batch in batches:
        start = size = 0
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if len(sizes) > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
