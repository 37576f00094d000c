"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.plans.storage import materialize


def held_out(key: Column) -> Column:
    """Rows that no classifier may learn from: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``text, label`` of up to ``per_class`` documents of each class, none of them held out.

    Which ones depends on a hash of the id only.  Of equal texts of one class one stays, else the words of
    a copied text would look like words of its class.  At most ``2 * per_class`` ids are broadcast.
    Labels that are null, or differ for one id, are left out.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most and label in (0, 1)")
        .select("_id", F.col("label").cast("int").alias("label"))
    )
    order = F.xxhash64(F.lit(31), F.col("_id")), F.col("_id")
    picked = [known.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = rows.join(few, "_id").select("text", "label").dropDuplicates()
    return materialize(sample, "sample")
