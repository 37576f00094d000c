"""How a cached access token is used and renewed over a log of calls.

A call renews the token unless it comes before the end of the token less ``early``.  So after a
renewal the next one is the first call at or after a certain time, and a log is a chain of such
jumps: each decision depends on the one before.  Yet a client's calls needn't be read one after another:

1. Calls are sorted in ranges by client and time, and packed into segments of at most ``segment`` calls of one client.
   A segment is one row, with its times as an array.
2. For segments of a client that has more than one, all in parallel: where does a chain that enters at a
   call leave?  A chain can only enter at calls up to ``lifetime - early`` after the last call of the segment before,
   and where several lead to one exit, only the last of them is kept.  These are the segment's table.
3. A client's tables are composed in order: one search in each table takes the time at which the
   chain may enter the next.  This reads tables, a row a segment, and holds one time.
4. With the time at which the chain enters it, each segment is walked by itself, again in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import materialize, scratch

#: A token is renewed so many seconds before it ends.
EARLY = 60.0
#: Calls of one client that are walked together: what a row of the tables between the steps holds.
SEGMENT = 1 << 16


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _next(at: np.ndarray, lifetime: float, early: float) -> tuple[np.ndarray, np.ndarray]:
    """For a renewal at each call: the time from which the next may come, and the call that it comes with (the number of calls: none here)."""
    after = at + lifetime - early
    return after, np.maximum(np.searchsorted(at, after), np.arange(1, len(at) + 1))


def _segments(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted calls as segments, in their order."""
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        calls = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        whole = pa.array([0, len(calls)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, _column(calls, c)) for c in ("at", "call")]
        at = _column(calls, "at")
        columns = [_column(calls, "client").slice(0, 1), at.slice(len(at) - 1), *lists]
        return pa.RecordBatch.from_arrays(columns, names=["client", "last", "ats", "calls"])

    for batch in batches:
        if not len(batch):
            continue
        client = _column(batch, "client")
        # Clients are compared as Spark has sorted them: equal neighbours are one client.
        codes = client.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(batch)]
        for low, high in zip(starts, starts[1:]):
            if held and _column(held[-1], "client")[0] != client[low]:
                yield packed()
                held, size = [], 0
            while low < high:
                take = min(high - low, segment - size)
                held.append(batch.slice(low, take))
                size, low = size + take, low + take
                if size == segment:
                    yield packed()
                    held, size = [], 0
    if held:
        yield packed()


def _tables(batches: Iterator[pa.RecordBatch], lifetime: float, early: float) -> Iterator[pa.RecordBatch]:
    """``entries`` and ``exits`` of segments: a chain that may enter from a time on leaves at the exit beside the first entry not before it."""
    for batch in batches:
        entries, exits = [], []
        ats, before = _column(batch, "ats"), _column(batch, "before").to_pylist()
        for k, last in enumerate(before):
            at = ats[k].values.to_numpy(zero_copy_only=False)
            after, then = _next(at, lifetime, early)
            leave = after.tolist()
            ends = len(at)
            for i in range(ends - 1, -1, -1):
                if then[i] < ends:
                    leave[i] = leave[then[i]]
            # The first segment is entered at its first call; the others no later than the one before allows.
            limit = 1 if last is None else int(np.searchsorted(at, last + lifetime - early)) + 1
            leave, at = np.array(leave[:limit]), at[:limit]
            keep = np.append(leave[1:] != leave[:-1], True)
            entries.append(at[keep])
            exits.append(leave[keep])
        lists = [pa.array(x, pa.list_(pa.float64())) for x in (entries, exits)]
        names = ["client", "part", "last"]
        yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in names), *lists], names=[*names, "entries", "exits"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``client, part, enters``: the time from which the chain may enter each segment, from tables in order."""
    current, from_time = None, float("-inf")
    for batch in batches:
        enters = []
        entries, exits, last = (_column(batch, c) for c in ("entries", "exits", "last"))
        for k, client in enumerate(_column(batch, "client")):
            if client != current:
                current, from_time = client, float("-inf")
            enters.append(from_time)
            if not last[k].as_py() < from_time:
                at = entries[k].values.to_numpy(zero_copy_only=False)
                from_time = exits[k].values[int(np.searchsorted(at, from_time))].as_py()
        columns = [_column(batch, "client"), _column(batch, "part"), pa.array(enters, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["client", "part", "enters"])


def _walked(batches: Iterator[pa.RecordBatch], lifetime: float, early: float) -> Iterator[pa.RecordBatch]:
    """Segments as rows of calls again, with ``refreshed``."""
    for batch in batches:
        ats, calls = _column(batch, "ats"), _column(batch, "calls")
        sizes = ats.value_lengths().to_numpy(zero_copy_only=False)
        times = ats.flatten()
        all_times, refreshed, first = times.to_numpy(zero_copy_only=False), np.zeros(len(times), bool), 0
        for size, from_time in zip(sizes.tolist(), _column(batch, "enters").to_pylist()):
            at = all_times[first : first + size].tolist()
            i = bisect_left(at, from_time)
            while i < size:
                refreshed[first + i] = True
                i = bisect_left(at, at[i] + lifetime - early, i + 1)
            first += size
        client = _column(batch, "client").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        columns = [client, times, calls.flatten(), pa.array(refreshed)]
        yield pa.RecordBatch.from_arrays(columns, names=["client", "now", "order", "refreshed"])


def segments_of(calls: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``client, last, ats, calls, part`` from ``client, at, call``: sorted calls, at most ``segment`` in a row; ``part`` rises with the order."""
    kinds = {f.name: f.dataType for f in calls.schema}
    packed = T.StructType([
        T.StructField("client", kinds["client"]), T.StructField("last", T.DoubleType()),
        T.StructField("ats", T.ArrayType(T.DoubleType())), T.StructField("calls", T.ArrayType(kinds["call"])),
    ])
    keys = ["client", "at", "call"]
    rows = calls.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Tasks are in the order of their ranges, and the number of the task comes first in the id.
    return rows.mapInArrow(lambda batches: _segments(batches, segment), packed).withColumn("part", F.monotonically_increasing_id())


def refresh_trace(
    calls: DataFrame, client: str, now: str, order: str, lifetime: float, early: float = EARLY, segment: int = SEGMENT
) -> DataFrame:
    """``client, now, order, refreshed`` for each call.

    Calls at one time are taken by ``order``; rows without a client or a time are left out, and a time that isn't a
    number comes last and always renews.  However many calls a client has, no task gets more of them than its range of the sort.
    """
    slim = calls.select(F.col(client).alias("client"), F.col(now).cast("double").alias("at"), F.col(order).alias("call"))
    slim = slim.where("client is not null and at is not null")
    kinds = {f.name: f.dataType for f in slim.schema}
    kind = kinds["client"].simpleString()
    with scratch(calls.sparkSession) as keep:
        segments = materialize(segments_of(slim, segment), "segments")
        several = segments.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("client")
        several = keep(several, "clients")
        found = segments.withColumn("enters", F.lit(float("-inf")))  # a client's only segment is entered at its first call
        if several.limit(1).count():
            linked = segments.join(broadcast_if_small(several), "client", "left_semi")
            last = F.lag("last").over(W.partitionBy("client").orderBy("part"))
            before = keep(linked.select("client", "part", last.alias("before")), "before")
            linked = linked.join(broadcast_if_small(before), ["client", "part"]).select("client", "part", "last", "ats", "before")
            tables = keep(linked.mapInArrow(
                lambda batches: _tables(batches, lifetime, early),
                f"client {kind}, part long, last double, entries array<double>, exits array<double>",
            ), "tables")
            ordered = tables.repartition("client").sortWithinPartitions("client", "part")
            enters = materialize(ordered.mapInArrow(_composed, f"client {kind}, part long, enters double"), "enters")
            found = segments.join(broadcast_if_small(enters), ["client", "part"], "left")
    found = found.select("client", "ats", "calls", F.coalesce("enters", F.lit(float("-inf"))).alias("enters"))
    schema = T.StructType([
        T.StructField("client", kinds["client"]), T.StructField("now", T.DoubleType()), T.StructField("order", kinds["call"]), T.StructField("refreshed", T.BooleanType()),
    ])
    return found.mapInArrow(lambda batches: _walked(batches, lifetime, early), schema)
