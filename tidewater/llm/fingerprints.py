"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

A text's UTF-8 byte triplets are hashed into ``BUCKETS`` counters.  The digest
has, for each counter, its place among the quartiles of all counters (two bits),
after one byte for the length on a logarithmic scale.  Two digests are compared
by a difference score: the distance of the two-bit codes, where opposite ends
count double, plus a capped difference of the length bytes.  The score is
bounded, so likeness is one minus its share of the most it can be.

Cases: a null text counts as empty, and an empty text has the all-zero digest;
equal texts have equal digests.  For neighbours by id, rows without an id have
none and their results about neighbours are null.  Rows with the same id are in
the order of a hash of their text.  A single row is its own neighbour.  Long texts
are counted whole, and empty tables give empty results.  Columns other than id and
text aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.llm.arrow import chunks, column, map_arrow

BUCKETS = 1024
_LENGTH_STEP = 1.1
_LENGTH_CAP, _LENGTH_WEIGHT = 32, 6
_MOST = 6 * BUCKETS + _LENGTH_WEIGHT * _LENGTH_CAP
#: Rows that an id range has, and ranges at most: a number for each is kept by the driver and sent to the tasks.
RANGE_ROWS, RANGES = 2_000, 100_000

_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
_GAP = np.abs(_CODES[:, None, :] - _CODES[None, :, :])
_DIFFERENCE = np.where(_GAP == 3, 6, _GAP).sum(axis=2).astype(np.int64)
_PLACES = np.array([1, 4, 16, 64], np.int64)


def digests(texts: pa.Array) -> list[bytes]:
    """The digest of each text of a column."""
    from tidewater.llm.shingles import _bytes_of

    data, offsets = _bytes_of(texts)
    buckets = np.zeros(0, np.int64)
    if len(data) > 2:
        b = data.astype(np.uint32)
        h = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77)
        buckets = ((h ^ h >> np.uint32(13)) % np.uint32(BUCKETS)).astype(np.int64)
    out = []
    for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        counts = np.bincount(buckets[a : max(a, e - 2)], minlength=BUCKETS)
        q = np.sort(counts)[[(BUCKETS - 1) // 4, (BUCKETS - 1) // 2, 3 * (BUCKETS - 1) // 4]]
        codes = (counts > q[0]).astype(np.int64) + (counts > q[1]) + (counts > q[2])
        length = min(255, round(math.log(e - a + 1, _LENGTH_STEP)))
        out.append(bytes([length]) + (codes.reshape(-1, 4) @ _PLACES).astype(np.uint8).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for the farthest."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    score = int(_DIFFERENCE[x[1:], y[1:]].sum()) + _LENGTH_WEIGHT * min(abs(int(x[0]) - int(y[0])), _LENGTH_CAP)
    return 1.0 - score / _MOST


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` (lowercase hex) of each whole text; needs no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = [d.hex() for d in digests(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(slim, run, "doc_id long, fingerprint string")


def _first_ids(ids: DataFrame, ranges: int) -> list[int]:
    """The smallest id of each of about ``ranges`` equal shares of the ids, in order; Spark cuts the shares."""
    shares = ids.where("doc_id is not null").repartitionByRange(ranges, "doc_id")
    lows = shares.groupBy(F.spark_partition_id().alias("share")).agg(F.min("doc_id").alias("low"))
    return sorted(r["low"] for r in lows.collect())


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, text, digest, next_text, next_digest``: each row beside the one with the next id.

    The ids are cut into ranges of about equal counts.  A range's first row is copied to the range
    before it, and the first of all to the last, so each range finds all its neighbours and texts are
    dealt once.  A range is sorted as it is read, and spills if need be; how many rows it has only matters for balance.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = slim.where("doc_id is not null").count()
    heads = _first_ids(slim.select("doc_id"), min(RANGES, math.ceil(n / RANGE_ROWS))) if n else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places = np.array(heads, np.int64), {v: k for k, v in enumerate(heads)}
        for batch in chunks(batches):
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            made = digests(texts)
            known = np.array([x is not None for x in ids.to_pylist()], bool)
            at = np.searchsorted(starts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
            at = np.where(known, at, -1 - np.arange(len(ids)) % 1024)
            again = [k for k, v in enumerate(ids.to_pylist()) if v in places]
            before = [(places[ids[k].as_py()] - 1) % len(heads) for k in again]
            pick = pa.array([*range(len(ids)), *again], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pick), texts.take(pick), pa.array(made + [made[k] for k in again], pa.binary()),
                    pa.array([*at.tolist(), *before], pa.int64()), pa.array([False] * len(ids) + [True] * len(again)),
                ],
                names=["doc_id", "text", "digest", "range", "copy"],
            )

    rows = map_arrow(slim, run, "doc_id long, text string, digest binary, range long, copy boolean")
    order = W.partitionBy("range").orderBy("copy", "doc_id", F.xxhash64("text"))
    return (
        rows.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_digest", F.lead("digest").over(order))
        .where("not copy")
        .select(
            "doc_id", "text", "digest",
            F.when(F.col("doc_id").isNotNull(), F.col("next_text")).alias("next_text"),
            F.when(F.col("doc_id").isNotNull(), F.col("next_digest")).alias("next_digest"),
        )
    )


def edited_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How near each text's fingerprint is to that of the text with its last half replaced, and to the next one's."""
    n = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, text, key).withColumn("n_chars", n).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "digest", "next_digest", "edited", F.sha2("edited", 256).alias("edited_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "edited"):
            own, after, edits = (column(batch, c).to_pylist() for c in ("digest", "next_digest", "edited"))
            made = [None if t is None else d for t, d in zip(edits, digests(column(batch, "edited")))]
            near = lambda other: pa.array(
                [None if b is None else likeness(a, b) for a, b in zip(own, other)], pa.float64()
            )
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), column(batch, "n_chars"), column(batch, "edited_sha256"),
                    pa.array([d.hex() for d in own], pa.string()),
                    pa.array([None if d is None else d.hex() for d in made], pa.string()), near(made), near(after),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return map_arrow(
        rows,
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
