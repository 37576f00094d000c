"""Mixing sources to target weights.

Each row gets a hash-random key.  Within a source, rows are ordered by that key;
a distributed prefix sum of sizes finds the row at which the source's budget is
reached, and rows before it are taken.  A budget above the source's size repeats
whole epochs first and cuts in the last one.

The order is never built for whole sources: keys are uniform, so equal-width key
ranges ("buckets") hold equal shares.  Bucket sums are prefix-summed, which
shows the one bucket of each source that holds its cut, and only the rows of
these buckets are sorted.  A source with a third of all rows just has more buckets.

Cases: a null source is a source of its own, ordered last.  A null or empty text
has size 0 and is never taken.  Repeated rows and repeated ids have the same
key: they stay adjacent and each counts its own size (ties are broken by text
hash, then any order, since tied rows are equal).  Where a cut goes through tied rows, :func:`mixed_documents` takes as
many of them as fit.  Empty tables give empty results.  Texts of any length are read where they are; only
their sizes and keys are moved.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import discard, materialize, scratch

#: Writes a table that several steps read.
Keep = Callable[[DataFrame, str], DataFrame]

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2.0
SEED = 17
#: Rows that a bucket holds on average; a cut sorts so many rows a source.
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    edge = F.when(F.get(parts, 0) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return (F.size(parts) - edge - tail).cast("long")


def _before(df: DataFrame, order: list[Column], keep: Keep, **values: Column) -> DataFrame:
    """Add, for each name, the sum of a value over all rows that come before in ``order``; sorted in ranges, not in one task."""
    parts = df.select("*", *(v.alias(f"_v{n}") for n, v in values.items())).repartitionByRange(*order)
    parts = keep(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    lower = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*(F.sum(f"_v{n}").alias(f"_t{n}") for n in values))
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t{n}").over(lower), F.lit(0)).alias(f"_t{n}") for n in values))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = parts.join(F.broadcast(totals), "_part")  # a row a partition
    sums = {n: F.col(f"_t{n}") + F.coalesce(F.sum(f"_v{n}").over(inside), F.lit(0)) for n in values}
    return rows.withColumns(sums).select(*df.columns, *values)


def targets(sizes: DataFrame, keep: Keep, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, n_rows`` -> with ``target``: shares by weight, capped at ``epochs`` sizes.

    Sources are ranked by code point with null last; weights repeat along the rank.
    The excess over a cap goes to the others by weight.  Sorted by size per weight
    that has one closed form: sources below the level at which the remaining budget
    per remaining weight stands are capped, the others get weight times level.
    """
    ranked = _before(sizes, [F.col("source").isNull(), F.col("source")], keep, _i=F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    filled = keep(_before(ranked, [F.col("_ratio"), F.col("_i")], keep, _capped=F.col("_cap"), _gone=F.col("_w")), "filled")
    whole = filled.agg((F.sum("source_size") * F.lit(float(share))).alias("_total"), F.sum("_w").alias("_weight"))
    level = (F.col("_total") - F.col("_capped")) / (F.col("_weight") - F.col("_gone"))
    at = filled.join(F.broadcast(whole)).withColumn("_own", level).where(F.col("_cap") > F.col("_w") * F.col("_own"))
    # The first source, in this order, whose cap isn't reached sets the level for it and all after it.
    first = at.agg(F.min(F.struct("_ratio", "_i", "_own")).alias("_first")).select("_first.*")
    first = first.select(F.col("_ratio").alias("_fr"), F.col("_i").alias("_fi"), F.col("_own").alias("_level"))
    open_ = (F.col("_ratio") > F.col("_fr")) | ((F.col("_ratio") == F.col("_fr")) & (F.col("_i") >= F.col("_fi")))
    target = F.when(open_, F.least("_cap", F.col("_w") * F.col("_level"))).otherwise(F.col("_cap"))
    return filled.join(F.broadcast(first)).select("source", "source_size", "n_rows", target.alias("target"))  # one row each


def _key(docs: DataFrame, text: str, key: str, seed: int) -> Column:
    """A uniform 60-bit key of a row's id and text, which any SQL engine can state; equal rows have equal keys."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(docs[key].cast("string"), F.lit("")), docs[text])
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    seed: int = SEED,
    weights=WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, whole_epochs, cut`` for each row.

    ``taken`` counts words: ``whole_epochs`` times the size, plus the whole size again for rows
    before the cut, plus what is left of the budget for the row at the cut.  A written table.
    """
    with scratch(docs.sparkSession) as keep:
        body = F.col(text)
        slim = keep(
            docs.select(
                F.col(key).alias("doc_id"),
                F.col(source).alias("source"),
                word_count(body).alias("size"),
                _key(docs, text, key, seed).alias("_k"),
            ),
            "mix",
        )
        plan = targets(
            slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")),
            keep, weights, share, epochs,
        )
        rest = F.col("target") - F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("source_size")
        plan = keep(
            plan.select(
                "source", "source_size", "target",
                F.greatest(F.lit(1), F.ceil(F.col("n_rows") / bucket_rows)).alias("_n"),
                F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).alias("whole_epochs"),
                F.round(rest).cast("long").alias("_budget"),
            ),
            "mix-plan",
        )
        # Keys are uniform: an equal-width range of keys is an equal share of the rows.
        position = F.col("_k") / F.lit(2.0**60)
        bucket = F.least(F.floor(position * F.col("_n")), F.col("_n") - 1).cast("long")
        rows = slim.join(broadcast_if_small(plan).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rows = rows.withColumn("_b", bucket)

        sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_sum"), F.first("_budget").alias("_budget"))
        before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        cuts = (
            sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .where((F.col("_before") < F.col("_budget")) & (F.col("_before") + F.col("_sum") >= F.col("_budget")))
            .select(F.col("source").alias("_cs"), F.col("_b").alias("_cut"), (F.col("_budget") - F.col("_before")).alias("_need"))
        )
        cuts = keep(cuts, "mix-cuts")  # one row a source at most
        rows = rows.join(broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("_cs")), "left").drop("_cs")
        at = F.col("_b") == F.col("_cut")
        inside = W.partitionBy("source", "_b").orderBy("_k", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
        cut_rows = rows.where(at).withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        cut_rows = cut_rows.withColumn("_part", F.least("size", F.greatest(F.lit(0), F.col("_need") - F.col("_run"))))
        other = rows.where(~F.coalesce(at, F.lit(False)))
        other = other.withColumn("_run", F.lit(0).cast("long")).withColumn(
            "_part", F.when(F.col("_b") < F.col("_cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
        )
        out = other.unionByName(cut_rows)
        out = out.select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("whole_epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
            F.col("whole_epochs").cast("int").alias("whole_epochs"),
            F.col("_part").cast("long").alias("last_part"),
            F.col("_k").alias("key"),
        )
        return materialize(out, "mixed")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with all their columns.

    A document that the cut goes through counts as taken.  Documents without words have no size
    that a budget could bound: they are taken once for each whole epoch of their source, at least once.

    The rows up to a source's cut are those whose key is at most that of the row at the cut, so the
    decision needs one short row a source, and texts stay where they are.  If several rows tie at the cut and not all
    fit, these rows are written and numbered, range by range.
    """
    found = mix(docs, text, key, source, **options)
    codes = [f"c{k}" for k in range(len(docs.columns))]
    text, key, source = (codes[docs.columns.index(name)] for name in (text, key, source))
    rows = docs.toDF(*codes)
    at = F.col("key") == F.col("_cut")
    with scratch(docs.sparkSession) as keep:
        plan = found.groupBy(F.col("source").alias("_s")).agg(
            F.max("whole_epochs").alias("_whole"), F.max(F.when(F.col("last_part") > 0, F.col("key"))).alias("_cut")
        )
        plan = keep(plan, "mix-cuts")
        ties = found.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_s"))).where(at)
        ties = ties.groupBy(F.col("source").alias("_t")).agg(F.count_if(F.col("last_part") > 0).alias("_fit"), F.count(F.lit(1)).alias("_tied"))
        ties = ties.where("_fit < _tied").select("_t", "_fit")
        plan = materialize(plan.join(ties, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_whole", "_cut", "_fit"), "mix-plan")
    discard(found)
    rows = rows.withColumns({"_key": _key(rows, text, key, options.get("seed", SEED)), "_size": word_count(F.col(text))})
    rows = rows.join(broadcast_if_small(plan), F.col(source).eqNullSafe(F.col("_s")))
    times = F.when(F.col("_size") == 0, F.greatest(F.col("_whole"), F.lit(1))).otherwise(
        F.col("_whole") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)
    )
    rows = rows.withColumn("_times", times)
    if plan.where("_fit is not null").limit(1).count():
        tied = (F.col("_size") > 0) & (F.col("_key") == F.col("_cut")) & F.col("_fit").isNotNull()
        some = _first_of(rows.where(tied), "_s", "_fit")
        rows = rows.where(~F.coalesce(tied, F.lit(False))).unionByName(some.withColumn("_times", F.col("_whole") + F.col("_first").cast("int")).drop("_first"))
    rows = rows.select(*codes, F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return rows.select(*codes).toDF(*docs.columns)


def _first_of(rows: DataFrame, group: str, fit: str) -> DataFrame:
    """Add ``_first``: whether a row is one of the first ``fit`` of its group, in the order in which the rows are written."""
    parts = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "tied")
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, part).orderBy("_at"))
    numbered = parts.withColumn("_row", inside).join(
        broadcast_if_small(materialize(counts, "tied-parts")), F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p"))
    )
    return numbered.withColumn("_first", F.col("_before") + F.col("_row") <= F.col(fit)).drop("_at", "_g", "_p", "_before", "_row")
