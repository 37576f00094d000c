"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the instance is a histogram with
at most ``capacity`` entries, whatever the number of documents.  On it:

1. Reduction.  For an item j, a set F that holds j dominates all others that hold
   j if in each of them the other items can be swapped, one against one or several
   against one, with the items of F.  Then F is a bin of some optimal packing and
   is fixed for good.  The tests are: j fits with nothing; j and another fill a
   bin exactly; at most one item fits beside j (the largest that fits dominates);
   at most two fit beside j (the largest single, or a pair with the largest sum,
   dominates).  Classes are fixed with their whole multiplicity at a time.
2. The rest is packed best fit, in decreasing size, with bins of equal room as a group.

The outcome is a short table of runs (size, range of ranks, first bin, place).
Spark ranks the pieces of each length - by prefix sums over hash groups, about as
many groups of a length as each has pieces, so a length that a third of the pieces
have isn't one task's work - and looks up each piece's bin in the runs.

Cases: a null or empty text is one piece of the end token.  Repeated rows are
pieces of their own.  Null ids are carried.  Empty tables give empty results.
Long texts are cut into pieces of at most ``capacity`` tokens, none is lost.
Columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidewater.llm.arrow import chunks, column, map_arrow
from tidewater.llm.tokens import piece_encoder
from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import materialize

CAPACITY = 4096
END_ID = 1


class Run(NamedTuple):
    """Items of ``size`` with ranks from ``low`` to below ``high``: ``per`` in each bin from ``bin`` on, at ``offset``."""

    size: int
    low: int
    high: int
    bin: int
    per: int
    offset: int


class _Instance:
    """Counts by size, with the live sizes in order."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c > 0}
        self.live = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            del self.live[bisect_left(self.live, size)]

    def others(self, *without: int) -> "_Others":
        return _Others(self, without)


class _Others:
    """The instance without one copy of each of some items."""

    def __init__(self, instance: _Instance, without: tuple[int, ...]):
        self.i, self.without = instance, without

    def count(self, size: int) -> int:
        return self.i.n.get(size, 0) - self.without.count(size)

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest items larger than ``above``, with multiplicity."""
        out: list[int] = []
        for s in self.i.live[bisect_right(self.i.live, above):]:
            out += [s] * min(self.count(s), k - len(out))
            if len(out) == k:
                break
        return out

    def largest(self, most: int) -> int:
        """The largest item of at most ``most``; 0 if there is none."""
        k = bisect_right(self.i.live, most) - 1
        while k >= 0 and self.count(self.i.live[k]) < 1:
            k -= 1
        return self.i.live[k] if k >= 0 else 0

    def best_pair(self, most: int) -> tuple[int, int]:
        """Two items (a >= b) with the largest sum of at most ``most``; (0, 0) if none."""
        live, best = [s for s in self.i.live[: bisect_right(self.i.live, most)] if self.count(s) > 0], (0, 0)
        low, high = 0, len(live) - 1
        while low <= high:
            a, b = live[high], live[low]
            if a + b > most:
                high -= 1
                continue
            if (a != b or self.count(a) > 1) and a + b > sum(best):
                best = (a, b)
            low += 1
        return best


def _dominating(rest: _Instance, j: int, capacity: int) -> tuple[int, ...] | None:
    """Items that go with j in a bin of some optimal packing, or None if no test tells."""
    room, others = capacity - j, rest.others(j)
    small = others.smallest(3)
    if not small or small[0] > room:
        return ()
    single = others.largest(room)
    if single == room or len(small) < 2 or small[0] + small[1] > room:
        return (single,)
    if len(small) == 3 and sum(small) <= room:
        return None
    a, b = others.best_pair(room)
    if single >= a + b:
        return (single,)
    if single == a:
        # A pair could only beat (a, b) with both items above b, and none such fits.
        between = rest.others(j, a).smallest(2, above=b)
        if len(between) < 2 or sum(between) > room:
            return (a, b)
    return None


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int, int]:
    """Runs, number of bins, and how many of the bins the reduction fixed."""
    rest, runs, used = _Instance(histogram), [], dict.fromkeys(histogram, 0)
    bins = 0

    def place(size: int, count: int, first: int, per: int, offset: int) -> None:
        runs.append(Run(size, used[size], used[size] + count, first, per, offset))
        used[size] += count

    changed = True
    while changed:
        changed = False
        for j in rest.live[::-1]:
            while rest.n.get(j):
                mates = _dominating(rest, j, capacity)
                if mates is None:
                    break
                items = [j, *mates]
                count = min(rest.n[s] // items.count(s) for s in items)
                offset = 0
                for s in dict.fromkeys(items):
                    place(s, count * items.count(s), bins, items.count(s), offset)
                    rest.take(s, count * items.count(s))
                    offset += s * items.count(s)
                bins += count
                changed = True
    fixed = bins
    rooms: list[int] = []  # in order; groups[room]: (first bin, number of bins)
    groups: dict[int, list[tuple[int, int]]] = {}

    def open_group(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for size in rest.live[::-1]:
        left = rest.n[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, count = capacity, bins, -(-left // (capacity // size))
                bins += count
            per = room // size
            full = min(count, left // per)
            if full:
                place(size, full * per, first, per, capacity - room)
                open_group(room - per * size, first, full)
                left -= full * per
            if full < count and 0 < left < per:
                place(size, left, first + full, left, capacity - room)
                open_group(room - left * size, first + full, 1)
                full, left = full + 1, 0
            open_group(room, first + full, count - full)
    return runs, bins, fixed


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Tokenize whole texts, append the end id, cut what is longer than ``capacity``: one row a piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode = piece_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in chunks(batches):
            out: list[tuple] = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), encode(column(batch, "text").to_pylist())):
                ids = np.concatenate((ids.astype("<u4", copy=False), end))
                n = len(ids)
                for k, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[start:stop])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=PIECE.names,
            )

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(slim, pieces, PIECE)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``pieces`` is read several times, so pass a written table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _, _ = solve(counts, capacity)  # both are bounded by capacity, not by the data
    spark = pieces.sparkSession
    by_size: dict[int, list[Run]] = {}
    for run in runs:
        by_size.setdefault(run.size, []).append(run)
    table = spark.createDataFrame(
        [(s, math.isqrt(counts[s]), [tuple(r)[1:] for r in own]) for s, own in by_size.items()],
        "length long, _n long, _runs array<struct<low:long,high:long,bin:long,per:long,offset:long>>",
    )
    rows = pieces.join(F.broadcast(table.select("length", "_n")), "length")  # at most capacity rows
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_n")))
    before = W.partitionBy("length").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(
        rows.groupBy("length", "_g")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("length", "_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")),
        "pack-starts",
    )
    rank = F.row_number().over(W.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = (
        rows.withColumn("_rank", rank)
        .join(broadcast_if_small(starts), ["length", "_g"])
        .join(F.broadcast(table.select("length", "_runs")), "length")
        .withColumn("_rank", F.col("_rank") + F.col("_start"))
    )
    run = F.get(F.filter("_runs", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"])), F.lit(0))
    rows = rows.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.low"))
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.bin") + F.floor(F.col("_k") / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + (F.col("_k") % F.col("_run.per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity=capacity, **names), "pieces"), capacity)
