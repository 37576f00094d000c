"""Completion of prompts that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidewater.operators.completion import Transport, complete


def complete_stream(
    prompts: DataFrame, make_transport: Callable[[], Transport], keys: list[str], sink: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the replies of each micro-batch to a Parquet table, once it is complete.

    The stage has no state, so batches are independent.  A batch that is run again after a
    failure is sent again; the sink's log keeps it from being written twice.
    """
    replies = complete(prompts, make_transport, keys, **options)
    return (
        replies.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
