"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

A row's leaf is the digest of its fields.  In each group (a language, say) leaves are ordered
by key; ``fanout`` consecutive nodes become their digest until one is left, the group's root.
The groups' roots, in order of the groups, become the root of the dataset in the same way.

Rows are numbered in key ranges, never in one task: a range-partitioned sort, a count for each
range and group, and prefix sums of these counts.  Then rows fall into blocks of ``fanout **
levels`` neighbours.  A block is one window partition, of bounded size however large the group is,
and no family of nodes crosses its edge.  A node stands in the row of its first leaf.  For each
level, lag and lead columns at fixed offsets (the level's stride, and multiples for a larger
fanout), masked by the node's slot and by the length of the run, give its siblings, and rows that
are first children hash their parent.  All levels of a block share one exchange and one sort.
Roots of blocks are the leaves of the next round, so a group of any size takes log(n) / levels rounds.

A path is the list of a leaf's siblings, level by level: what stands left and right of it, as hex
digits.  :func:`fold` hashes a leaf along a path to the root, which proves that the leaf is in the
tree without any other row.

Cases: a null field is written ``-``, so a null and an empty text differ.  Null keys come first, a null
group is a group of its own that comes first.  Rows with one key are ordered by leaf; repeated rows have equal leaves,
each is a leaf of its own, and it doesn't matter which comes first.  A group of one row has that leaf as
its root and no path there.  Texts count whole, whatever their length; they are hashed where they are
read and never shuffled.  Empty tables give empty results.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import materialize, scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Leaves of a block, at most: the rows that a window holds.
BLOCK = 1024
#: Writes a table that is gone when the operator ends.
Keep = Callable[[DataFrame, str], DataFrame]

_NO_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it stands in a leaf: its length in bytes, a colon and the value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return digest(*map(field, values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, start, lambda node, near: digest(near["left"], node, near["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda near: F.concat(near["left"], near["right"])), ""))


def _numbered(rows: DataFrame, keep: Keep) -> DataFrame:
    """Add ``_pos``, the number of a row in its ``_group`` by ``_key`` and ``_leaf``, and ``_n``, the rows of the group."""
    order = ["_group", "_key", "_leaf"]
    # The id is the number of the range, and below that the number of the row in it.
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = keep(parts.withColumn("_part", F.shiftright("_at", 33)), "leaves")
    runs = parts.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy("_group")).alias("_n"),
    )
    here = F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    numbered = parts.join(broadcast_if_small(keep(runs, "ranges")), here)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_pos"), "_n")


def _levels(fanout: int, block: int, most: int) -> int:
    """Levels of a round: as many as a block holds, and no more than a group of ``most`` nodes has."""
    levels = 1
    while fanout ** (levels + 1) <= block and fanout**levels < most:
        levels += 1
    return levels


def _block_paths(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (``_group, _pos, _n, _leaf`` and others) with ``_path`` in its block; ``_top``, in the block's first row, is its root."""
    size = fanout**levels
    w = W.partitionBy("_group", "_block").orderBy("_pos")
    df = nodes.withColumn("_block", F.expr(f"_pos div {size}")).withColumn("_d0", F.col("_leaf"))
    for level in range(levels):
        stride, node = fanout**level, F.col(f"_d{level}")
        slot = F.expr(f"_pos div {stride} % {fanout}")
        # Nodes stand in rows that the stride divides; nodes of a run are a stride apart.
        lags = [F.when(slot >= j, F.lag(node, j * stride).over(w)) for j in range(fanout - 1, 0, -1)]
        leads = [F.when(slot + j < fanout, F.lead(node, j * stride).over(w)) for j in range(1, fanout)]
        df = df.select("*", F.concat_ws("", *lags).alias(f"_l{level}"), F.concat_ws("", *leads).alias(f"_r{level}"))
        parent = F.when(F.col("_n") > stride, digest(node, F.col(f"_r{level}"))).otherwise(node)
        df = df.select("*", F.when(F.expr(f"_pos % {stride * fanout} = 0"), parent).alias(f"_d{level + 1}"))
    # The last node at or before a leaf's row is the one above it.
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    near = [
        F.last(
            F.when((F.col("_n") > fanout**k) & F.expr(f"_pos % {fanout**k} = 0"), F.struct(F.col(f"_l{k}").alias("left"), F.col(f"_r{k}").alias("right"))),
            ignorenulls=True,
        ).over(so_far)
        for k in range(levels)
    ]
    path = F.filter(F.array(*near), lambda x: x.isNotNull()).cast(_NO_PATH)
    return df.select(*nodes.columns, "_block", path.alias("_path"), F.col(f"_d{levels}").alias("_top"))


def _tree(rows: DataFrame, fanout: int, block: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``_group, _key, _leaf`` and others) with ``_path`` to the group's root; and ``_group, _root`` for each group."""
    nodes = _numbered(rows, keep)
    most = nodes.agg(F.max("_n")).head()[0] or 0
    rounds: list[DataFrame] = []
    while True:
        levels = _levels(fanout, block, most)
        size = fanout**levels
        rounds.append(keep(_block_paths(nodes, fanout, levels), f"blocks-{len(rounds)}"))
        tops = rounds[-1].where("_top is not null").select(
            "_group", F.col("_block").alias("_pos"), F.expr(f"(_n + {size - 1}) div {size}").alias("_n"), F.col("_top").alias("_leaf")
        )
        if most <= size:
            break
        nodes, most = tops, -(-most // size)
    above: DataFrame | None = None
    for number, table in reversed(list(enumerate(rounds))):
        if above is not None:
            above = above.select(F.col("_group").alias("_g"), F.col("_pos").alias("_b"), F.col("_path").alias("_more"))
            match = F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))
            table = table.join(broadcast_if_small(keep(above, "paths")), match).withColumn("_path", F.concat("_path", "_more"))
        above = table.select(*(rows.columns if number == 0 else ("_group", "_pos")), "_path")
    return above, keep(tops.select("_group", F.col("_leaf").alias("_root")), "roots")


def merkle_paths(
    rows: DataFrame, group: str, key: str, leaf: str, fanout: int = FANOUT, block: int = BLOCK
) -> DataFrame:
    """``rows`` with ``subroot`` (of its group), ``root`` and ``path`` (array of ``left, right``); a written table."""
    names = {f"c{k}": name for k, name in enumerate(rows.columns)}
    slim = rows.toDF(*names)
    inner = {name: code for code, name in names.items()}
    slim = slim.select(
        *slim.columns, F.col(inner[group]).alias("_group"), F.col(inner[key]).alias("_key"), F.col(inner[leaf]).alias("_leaf")
    )
    with scratch(rows.sparkSession) as keep:
        leaves, roots = _tree(slim, fanout, block, keep)
        tops = roots.select(F.lit(0).alias("_group"), F.col("_group").alias("_key"), F.col("_root").alias("_leaf"))
        groups, whole = _tree(tops, fanout, block, keep)
        # One row a group, and one row.
        groups = groups.join(F.broadcast(whole.select("_root"))).select(
            F.col("_key").alias("_g"), F.col("_leaf").alias("_subroot"), "_root", F.col("_path").alias("_more")
        )
        out = leaves.join(broadcast_if_small(keep(groups, "groups")), F.col("_group").eqNullSafe(F.col("_g")))
        out = out.select(
            *(F.col(code).alias(name) for code, name in names.items()),
            F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.concat("_path", "_more").alias("path"),
        )
        return materialize(out, "merkle")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, path`` for each row, with the names of ``key`` and ``group``."""
    slim = docs.select(key, group, leaf(*map(F.col, fields)).alias("leaf"))
    return merkle_paths(slim, group, key, "leaf", **options)


def tamper_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof, tried on rows some of which were changed.

    Rows whose id's CRC-32 is divisible by 7 have one character more counted than when the manifest was made.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    now = [F.when(changed, F.try_add(F.col(c), F.lit(1))).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    slim = docs.select("doc_id", "lang", leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(changed, leaf(*now)).alias("changed"))
    found = merkle_paths(slim, "lang", "doc_id", "leaf", **options)
    found = found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
