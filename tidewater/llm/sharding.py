"""Sharding by a k-d tree over document metadata, to shards of near equal bytes.

A node that stands for k shards is split along its widest dimension at the
weighted quantile floor(k / 2) / k of its bytes, until each leaf is one shard.
All nodes of a level are split together.  The quantile is found by distributed
histograms: each row has, per dimension, one 60-bit place (dimension value
first, then text hash, then id hash, so rows with equal texts are neighbours);
a round sums bytes by node and the next 10 bits of the place, and goes on in
the one bin that holds the quantile until that bin weighs next to nothing.
What the driver holds is the tree: one place a node.

Cases: a null text counts 8 bytes and CRC-32 0; null dimensions count as 0 or
the empty string; repeated rows share a place and may all fall to one side of a
cut; with fewer rows than shards some shards stay empty; an empty table gives
an empty result.  Of a long text only lengths and hashes are used.  Columns other
than id, text and ``lang``, which may be missing, aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import discard, materialize

SHARDS = 24
#: Bits of a place: the dimension's value, the text's hash, the id's hash.
_VALUE_BITS, _TEXT_BITS, _ID_BITS, _ROUND_BITS = 20, 20, 20, 10
#: A bin that weighs less than this share of a shard isn't opened any further.
TOLERANCE = 0.0005
#: Copies of one text stay together unless they weigh more than so many times that.
WHOLE_TEXT = 20
#: Rows that a slot group holds on average.
GROUP_ROWS = 20_000


def _scaled(value: Column, low: float, high: float) -> Column:
    """A value as an integer of ``_VALUE_BITS`` bits, in order."""
    top = (1 << _VALUE_BITS) - 1
    width = max(high - low, 1e-12)
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor((value - F.lit(low)) / F.lit(width) * top))).cast("long")


def metadata(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Id, size, CRC-32 and the dimensions: log size, language, bytes a character, line length.

    ``source`` is none of them: copies of a text come from many sources, and would be torn apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 8
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return docs.select(
        F.col(key).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"),
        (F.log2(size) / 20).alias("_d0"),
        (F.pmod(F.xxhash64(lang), F.lit(4096)) / 4096).alias("_d1"),
        (F.octet_length(body) / F.greatest(F.length(body), F.lit(1)) - 1).alias("_d2"),
        (F.log2(F.octet_length(body) / lines + 1) / 20).alias("_d3"),
        F.pmod(F.xxhash64(body), F.lit(1 << _TEXT_BITS)).alias("_tb"),
        F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << _ID_BITS)).alias("_ib"),
    )


DIMENSIONS = ("_d0", "_d1", "_d2", "_d3")


def _place(dimension: str, low: float, high: float) -> Column:
    value = _scaled(F.col(dimension), low, high)
    return value * (1 << (_TEXT_BITS + _ID_BITS)) + F.col("_tb") * (1 << _ID_BITS) + F.col("_ib")


def _by_node(exprs: dict[int, Column]) -> Column:
    out = F
    for node, value in exprs.items():
        out = out.when(F.col("_node") == node, value)
    return out


def _cuts(rows: DataFrame, places: dict[int, Column], goals: dict[int, float], ounce: dict[int, float]) -> dict[int, int]:
    """For each node the place below which it has about ``goals`` bytes."""
    rows = rows.where(F.col("_node").isin(list(places))).select("_node", "size", _by_node(places).alias("_p"))
    shift = _VALUE_BITS + _TEXT_BITS + _ID_BITS
    prefix, before, done = dict.fromkeys(places, 0), dict.fromkeys(places, 0), {}
    while len(done) < len(places):
        shift -= _ROUND_BITS
        inside = F.shiftright("_p", shift + _ROUND_BITS) == _by_node({n: F.lit(prefix[n]) for n in places if n not in done})
        sums = (
            rows.where(inside)
            .groupBy("_node", F.shiftright("_p", shift).alias("_bin"))
            .agg(F.sum("size").alias("bytes"))
            .orderBy("_node", "_bin")
            .collect()  # at most 2 ** _ROUND_BITS rows for each of a level's nodes
        )
        for r in sums:
            n = r["_node"]
            if n in done:
                continue
            after = before[n] + r["bytes"]
            if after < goals[n]:
                before[n] = after
            elif shift == 0 or r["bytes"] <= ounce[n] * (WHOLE_TEXT if shift <= _ID_BITS else 1):
                done[n] = r["_bin"] + (after - goals[n] < goals[n] - before[n])
                done[n] <<= shift
            else:
                prefix[n], done[n] = r["_bin"], None  # None: no further bin of this round
        done = {n: v for n, v in done.items() if v is not None}
    return done


def kd_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row; sizes of shards are near equal."""
    level = materialize(metadata(docs, text, key).withColumn("_node", F.lit(0)), "kd")
    leaves = {0: (0, shards)}  # node: its first shard and how many shards it stands for
    while wide := {n: k for n, (_, k) in leaves.items() if k > 1}:
        spans = (
            level.where(F.col("_node").isin(list(wide)))
            .groupBy("_node")
            .agg(
                F.sum("size").alias("bytes"),
                *(f(c).alias(f"{end}{c}") for c in DIMENSIONS for end, f in (("lo", F.min), ("hi", F.max))),
            )
            .collect()  # a row a node
        )
        places, goals, ounce = {}, {}, {}
        for r in spans:
            n, c = r["_node"], max(DIMENSIONS, key=lambda c: r["hi" + c] - r["lo" + c])
            places[n] = _place(c, r["lo" + c], r["hi" + c])
            goals[n] = r["bytes"] * (wide[n] // 2) / wide[n]
            ounce[n] = TOLERANCE * r["bytes"] / wide[n]
        for n, k in wide.items():
            first = leaves.pop(n)[0]
            leaves[2 * n + 1], leaves[2 * n + 2] = (first, k // 2), (first + k // 2, k - k // 2)
        if not places:
            continue
        cuts = _cuts(level, places, goals, ounce)
        sides = {n: F.when(places[n] < cuts[n], 2 * n + 1).otherwise(2 * n + 2) for n in places}
        last, level = level, materialize(level.withColumn("_node", F.coalesce(_by_node(sides), "_node")), "kd")
        discard(last)
    shard = _by_node({n: F.lit(first) for n, (first, _) in leaves.items()})
    return _with_slots(level.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "_tb", "_ib"))


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard gaplessly from 0.

    Rows of a shard are dealt by hash to groups of about ``GROUP_ROWS``; a row's slot is the
    number of rows in the groups before its own plus its rank in the group.
    """
    counts = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("_n"))
    placed = placed.join(F.broadcast(counts), "shard")  # a row a shard
    place = F.xxhash64("_ib", "_tb", "doc_id")
    placed = placed.withColumn("_g", F.pmod(place, F.col("_n")))
    sizes = placed.groupBy("shard", "_g").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("shard").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(
        sizes.select("shard", "_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")), "kd-slots"
    )
    rank = F.row_number().over(W.partitionBy("shard", "_g").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.join(broadcast_if_small(starts), ["shard", "_g"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + rank).alias("slot")
    )
