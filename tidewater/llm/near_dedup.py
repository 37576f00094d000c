"""Near-duplicate documents by min-max hashing with exact confirmation.

Each document's set of word shingles gets, under each of a number of hash
permutations, its minimum and its maximum: two signature values for one hash
evaluation, each equal for two sets with probability equal to their similarity.
Values are cut into bands; sets that agree in a band are candidates.

1. Equal sets become one class, represented by the smallest id, and of the texts of that id
   the one with the smallest hash.  Sets are told apart by 128 bits and classes then numbered,
   so texts that share an id stay apart, and no two classes have one number.
2. In each bucket every class is compared with the bucket's smallest: a star, not all pairs.
3. Links, confirmed on full sets, give components.  Pairs are confirmed in groups of one set, which is
   sent once, with the sets that are compared with it; the pairs of a busy set are dealt to many groups.  A bucket whose classes are all in one
   component is settled.
4. In the buckets that are left, pairs from different components whose signatures and sizes
   allow the threshold are confirmed on full sets as well.
5. Classes of buckets that are left and large are compared by their rare shingles instead: all
   sets are put in one order, rarest shingles first, and two that reach the threshold must share
   one among the first ``n - ceil(percent / 100 * n) + 1`` of the larger set and the first
   ``n - ceil(2 * percent / (100 + percent) * n) + 1`` of the smaller.  That loses no pair, and
   texts on one template, each with enough shingles of its own, meet in none.  What shares a
   shingle is compared in blocks, so no task holds more than two.
6. Components over all links.

So any two classes that share a bucket end in one component if they are linked: the only
links that can be missed are of sets that share no band.  There are as many bands as keep
the chance of that, (1 - threshold ** 5) ** bands, at one in a million at most for a pair at
the threshold: 24 at 85 percent, 35 at 80.

Cases: a text without words has no shingles and is linked with nothing; one with
fewer words than a shingle is one shingle.  Repeated rows fall in one class, and each
row of the smallest id is kept.  Rows without an id are kept if no row with an id has the
same set.  Texts that share an id are decided each by itself.  Long texts are hashed whole.  Empty tables give empty results.
Columns other than id and text aren't looked at; the stage keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.arrow import chunks, column, map_arrow
from tidewater.llm.components import components
from tidewater.llm.shingles import _mixed, shingle_sets
from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import discard, materialize, scratch

BAND_ROWS = 5
#: Chance that a pair at the threshold shares no band, at most.
_MISSED = 1e-6
#: Linked if 100 * intersection >= percent * union, where nothing else is asked for.
PERCENT = 85
#: Permutations of the signatures that pairs of step 4 are estimated by, two values each.
WIDE = 512
#: Pairs that agree less than so many deviations below the threshold, over all values or over a part of so many,
#: aren't confirmed.
_DEVIATIONS, _PART = 5.7, 128
_BLOCK, _PAIRS = 2048, 16_384
#: Pairs of one set that are confirmed together, about.
_GROUP = 256
#: A shingle with more than one of so many of all occurrences is hot: there are fewer than that.
_HOT = 10_000
#: Writes a table that is gone when the operator ends.
Keep = Callable[[DataFrame, str], DataFrame]

_SKETCH = "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def _bands(percent: int) -> int:
    """As many bands as a pair at the threshold needs."""
    return math.ceil(math.log(_MISSED) / math.log(1 - (percent / 100) ** BAND_ROWS)) if percent < 100 else 1


def _least(percent: int, values: int) -> float:
    """The share of equal values, of so many, below which a pair is taken to be under the threshold."""
    share = percent / 100
    return share - _DEVIATIONS * math.sqrt(share * (1 - share) / values)


def _min_max(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the hashes under each permutation (a multiplication by an odd factor)."""
    half = (found >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(factors), 2**32 - 1, np.uint32), np.zeros(len(factors), np.uint32)
    width = max(256, 250_000 // len(factors))
    for k in range(0, len(half), width):
        moved = factors * half[k : k + width]
        np.minimum(low, moved.min(axis=1), out=low)
        np.maximum(high, moved.max(axis=1), out=high)
    return np.concatenate((low, high))


def _factors(n: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None]


def _bytes(signature: np.ndarray) -> np.ndarray:
    """One byte of each value, enough to tell apart all but 1 in 256."""
    return _mixed(signature.astype(np.uint64)).astype(np.uint8)


def _sketches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    n_bands = _bands(percent)
    permutations = math.ceil(n_bands * BAND_ROWS / 2)
    factors, rng = _factors(permutations, 85), np.random.default_rng(24)
    order = rng.permutation(2 * permutations)[: n_bands * BAND_ROWS]
    steps = rng.integers(1, 2**63, BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    band = np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in chunks(batches):
        n, hi, lo, bands = [], [], [], []
        for found in shingle_sets(column(batch, "text")):
            n.append(len(found))
            digest = xxhash.xxh3_128_digest(found.tobytes())
            hi.append(int.from_bytes(digest[:8], "little", signed=True))
            lo.append(int.from_bytes(digest[8:], "little", signed=True))
            if not len(found):
                bands.append(None)
                continue
            h = band.copy()
            for k, part in enumerate(_min_max(found, factors)[order].reshape(n_bands, BAND_ROWS).T):
                h = _mixed(h + part.astype(np.uint64) * steps[k])
            bands.append(h.astype(np.int64))
        longs = [pa.array(c, pa.int64()) for c in (n, hi, lo)]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "text_hash"), *longs, pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = _factors(WIDE, 512)
    for batch in chunks(batches, most=1_000_000):
        found = list(shingle_sets(column(batch, "text")))
        wide = [_bytes(_min_max(s, factors)).tobytes() for s in found]
        binary = [pa.array(c, pa.binary()) for c in ([s.tobytes() for s in found], wide)]
        yield pa.RecordBatch.from_arrays([column(batch, "id"), *binary], names=["id", "set", "wide"])


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate((x, y))
    merged.sort()
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked.  Rows are sorted: the set of a group, without ``b``, then those that are compared with it."""
    own = np.zeros(0, np.uint64)
    for batch in batches:
        links: list[tuple[int, int]] = []
        for a, b, data in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), column(batch, "set")):
            found = np.frombuffer(data.as_buffer(), np.uint64)
            if b is None:
                own = found.copy()  # may be used for the next batch, when this one is gone
            elif _reach(own, found, percent):
                links.append((a, b))
        ends = [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _dealt(pairs: DataFrame, keep: Keep) -> DataFrame:
    """Written ``pairs`` as ``a, b, part``, where ``a`` is the busier end and ``part`` one of its groups.

    ``b`` is then in at most the square root of twice the number of pairs, as each of its partners is in as many.
    """
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    busy = keep(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _GROUP), "busy")
    table = broadcast_if_small(busy)
    for end in "ab":
        pairs = pairs.join(table.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end, "left")
    n_a, n_b = (F.coalesce(f"n_{end}", F.lit(1)) for end in "ab")
    pairs = pairs.select(
        F.when(n_a < n_b, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b")).alias("pair"),
        F.ceil(F.greatest(n_a, n_b) / _GROUP).alias("parts"),
    )
    return pairs.select("pair.*", F.pmod(F.xxhash64("pair.b"), "parts").alias("part"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """The pairs (a, b) that are linked, each once and either way round."""
    pairs = keep(_dealt(keep(pairs, "pairs"), keep), "dealt")
    heads = pairs.select("a", "part").distinct().join(sets.select(F.col("id").alias("a"), "set"), "a")
    others = pairs.join(sets.select(F.col("id").alias("b"), "set"), "b")
    rows = heads.withColumn("b", F.lit(None).cast("long")).unionByName(others).repartition("a", "part")
    rows = rows.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "set")
    return map_arrow(rows, lambda batches: _confirmed(batches, percent), "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that no group goes over the end of one."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        values = [column(batch, c).to_numpy() for c in by]
        new = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            yield batch.slice(0, last)
        rest = batch.slice(last)
    if rest is not None:
        yield rest


def _pair_numbers(keys: list[np.ndarray], left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs inside groups, about ``_PAIRS`` at a time: all, or those of a ``left`` row with one that isn't."""
    n = len(keys[0])
    edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    first, second, size = [], [], 0
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), n]):
        rows = np.arange(start, end)
        from_rows, to_rows = (rows[:-1], rows) if left is None else (rows[left[start:end]], rows[~left[start:end]])
        for k in from_rows.tolist():
            to = rows[k + 1 - start :] if left is None else to_rows
            first.append(np.full(len(to), k))
            second.append(to)
            size += len(to)
            if size >= _PAIRS:
                yield np.concatenate(first), np.concatenate(second)
                first, second, size = [], [], 0
    if size:
        yield np.concatenate(first), np.concatenate(second)


def _across(batches: Iterator[pa.RecordBatch], percent: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group that are in different components and may reach the threshold.

    Rows of a bucket have their ``bands``, and a pair is given out in the first band it shares only.  Rows
    of a shared shingle have ``is_left`` instead: the smaller of two sets must be a left row.  A part of the signature
    rules out most pairs before the whole of it is compared.
    """
    rough, estimate = _least(percent, _PART), _least(percent, 2 * WIDE)
    for batch in _grouped(batches, keys):
        groups = [column(batch, k).to_numpy() for k in keys]
        ids, comp, size = (column(batch, c).to_numpy() for c in ("id", "component", "n_shingles"))
        sig = np.frombuffer(b"".join(column(batch, "wide").to_pylist()), np.uint8).reshape(len(ids), 2 * WIDE)
        part = np.ascontiguousarray(sig[:, :: 2 * WIDE // _PART])
        tests = [lambda i, j: (part[i] == part[j]).mean(axis=1) >= rough]
        if "bands" in batch.schema.names:
            left, bands = None, column(batch, "bands").flatten().to_numpy().reshape(len(ids), -1)
            here = np.argmax(bands == groups[0][:, None], axis=1)
            tests.append(lambda i, j: np.argmax(bands[i] == bands[j], axis=1) == here[i])
        else:
            left = column(batch, "is_left").to_numpy(zero_copy_only=False)
        tests.append(lambda i, j: (sig[i] == sig[j]).mean(axis=1) >= estimate)
        found = []
        for i, j in _pair_numbers(groups, left):
            ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            if left is not None:
                ok &= (size[i] < size[j]) | (size[i] == size[j]) & (ids[i] < ids[j])
            i, j = i[ok], j[ok]
            for test in tests:
                if len(i):
                    ok = test(i, j)
                    i, j = i[ok], j[ok]
            found.append(np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))))
        made = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["a", "b"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n_shingles, key`` for each shingle of each set."""
    for batch in batches:
        for i, data in zip(column(batch, "id").to_pylist(), column(batch, "set")):
            found = np.frombuffer(data.as_buffer(), np.int64)
            for low in range(0, len(found), 100_000):
                some = found[low : low + 100_000]
                longs = (np.full(len(some), i), np.full(len(some), len(found)), some)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in longs], names=["id", "n_shingles", "key"])


def _first(percent: int, of: int) -> Column:
    """How many of a set's first shingles hold one that it shares, if it shares at least ``percent`` of each ``of``."""
    return F.expr(f"n_shingles - (n_shingles * {percent}L + {of - 1}L) div {of}L + 1")


def _rare_shingles(sets: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """``id, n_shingles, key, is_left`` for the shingles of each set that it must share one of with any set that it is linked with.

    ``is_left`` marks those that do as the smaller set.  Shingles of one set only are left out, but count for the order.
    Hot shingles are looked up in a broadcast table, of fewer than ``_HOT`` rows; of the others none can fill a task.
    """
    entries = keep(map_arrow(sets.select("id", "set"), _members, "id long, n_shingles long, key long"), "entries")
    counts = keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingle-counts")
    total = entries.count()
    hot = F.broadcast(counts.where(F.col("n") * _HOT > total))
    known = entries.join(hot, "key").unionByName(
        entries.join(hot, "key", "left_anti").join(counts.where(F.col("n") * _HOT <= total), "key")
    )
    of_set = Window.partitionBy("id")
    place = F.row_number().over(of_set.orderBy("n", "key")) + F.col("n_shingles") - F.count(F.lit(1)).over(of_set)
    known = known.withColumn("place", place).where(F.col("place") <= _first(percent, 100))
    return known.select("id", "n_shingles", "key", (F.col("place") <= _first(2 * percent, 100 + percent)).alias("is_left"))


def _by_rare_shingles(placed: DataFrame, sets: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """Pairs (a, b) of ``placed`` (id, component) in different components that may reach the threshold."""
    entries = keep(_rare_shingles(sets.join(placed, "id", "left_semi"), percent, keep).join(placed, "id"), "rare-shingles")
    blocks = lambda n: F.ceil(n / _BLOCK).alias
    shared = (
        entries.groupBy("key")
        .agg(
            F.min("component").alias("x"), F.max("component").alias("y"),
            blocks(F.count_if("is_left"))("lefts"), blocks(F.count(F.lit(1)))("rights"),
        )
        .where("x < y and lefts > 0").select("key", "lefts", "rights")
    )
    met = entries.join(broadcast_if_small(keep(shared, "shared-shingles")), "key")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["key", "id", "component", "n_shingles"]
    left = met.where("is_left").select(*columns, F.lit(True).alias("is_left"), block("lefts").alias("low"), every("rights").alias("high"))
    right = met.select(*columns, F.lit(False).alias("is_left"), every("lefts").alias("low"), block("rights").alias("high"))
    rows = left.unionByName(right).join(sets.select("id", "wide"), "id")
    return _compared(rows, percent, ["key", "low", "high"])


def _compared(rows: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    # Comparing is work, not bytes: a number of partitions that Spark doesn't lower by size.
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys)
    return map_arrow(rows, lambda batches: _across(batches, percent, keys), "a long, b long")


def _linked(docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class_id, first_id, first_hash`` for each row.

    The last two name the text that its component keeps; they are null for a row that is in no class.
    A written table; all others are gone.
    """
    with scratch(docs.sparkSession) as keep:
        return _linked_rows(docs, text, key, percent, keep)


def _linked_rows(docs: DataFrame, text: str, key: str, percent: int, keep: Keep) -> DataFrame:
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    sketches = keep(map_arrow(slim, lambda batches: _sketches(batches, percent), _SKETCH), "sketches")
    classes = keep(
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"))
        .select(
            "set_hi", "set_lo", F.col("own.doc_id").alias("class_id"), F.col("own.text_hash").alias("class_hash"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "classes",
    )
    own = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    members = keep(
        sketches.join(classes, ["set_hi", "set_lo"], "left").select(
            "doc_id", "text_hash", "n_shingles", "class_id", "class_hash", "id", F.when(own, F.col("bands")).alias("bands"),
        ),
        "members",
    )
    reps = members.where("bands is not null").select("id", "class_id", "class_hash", "n_shingles", "bands")
    keys = reps.select("id", "class_id", "class_hash", "n_shingles", F.explode("bands").alias("key"))
    # The star's centre is the class with the smallest id: most often the text that the others were made from.
    shared = (
        keys.groupBy("key").agg(F.min(F.struct("class_id", "id", "n_shingles")).alias("first"), F.min("id").alias("x"), F.max("id").alias("y"))
        .where("x < y").select("key", F.col("first.id").alias("first"), F.col("first.n_shingles").alias("first_n"))
    )
    buckets = keep(keys.join(shared, "key"), "buckets")

    ids = buckets.select("id", F.col("class_id").alias("doc_id"), F.col("class_hash").alias("text_hash")).distinct()
    ids = keep(ids, "candidates")
    texts = slim.join(broadcast_if_small(ids), ["doc_id", "text_hash"]).select("id", "text")
    sets = keep(map_arrow(texts, _sets, "id long, set binary, wide binary"), "sets")

    sizes = [f("n_shingles", "first_n") for f in (F.least, F.greatest)]
    stars = buckets.where((F.col("id") != F.col("first")) & (100 * sizes[0] >= percent * sizes[1]))
    stars = stars.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = keep(_confirm(stars, sets, percent, keep), "star-links")
    joined = components(links)

    placed = buckets.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = keep(placed, "placed")
    discard(joined)
    open_keys = (
        placed.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
        .where("x < y").select("key", "n")
    )
    open_keys = keep(open_keys, "open")
    left = placed.join(open_keys.where(F.col("n") <= _BLOCK), "key").join(reps, "id").join(sets.select("id", "wide"), "id")
    across = _compared(left.select("key", "id", "component", "n_shingles", "wide", "bands"), percent, ["key"])
    large = open_keys.where(F.col("n") > _BLOCK)
    if not large.isEmpty():
        crowd = placed.join(broadcast_if_small(large), "key").select("id", "component").distinct()
        across = across.union(_by_rare_shingles(keep(crowd, "crowd"), sets, percent, keep))
    more = keep(_confirm(across.distinct(), sets, percent, keep), "cross-links")
    joined = components(links.union(more))

    firsts = joined.join(ids, "id").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    firsts = joined.join(firsts, "component").select("id", "first")
    out = members.join(firsts, "id", "left")
    out = out.select(
        "doc_id", "text_hash", "n_shingles", "class_id", F.coalesce("first.doc_id", "class_id").alias("first_id"),
        F.coalesce("first.text_hash", "class_hash").alias("first_hash"),
    )
    out = materialize(out, "near")
    discard(joined)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for each row; ``percent`` is the similarity that links."""
    component = F.coalesce("first_id", "doc_id")
    return _linked(docs, text, key, percent).select(
        "doc_id", "n_shingles", "class_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are in no class or are their component's first text, with all their columns.

    Rows with the same id and the same text become one row; rows without an id are never repeats.
    """
    codes = [f"c{k}" for k in range(len(docs.columns))]
    text, key = (codes[docs.columns.index(name)] for name in (text, key))
    rows = docs.toDF(*codes)
    found = _linked(rows, text, key, percent)
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    stays = F.col("first_id").isNull() | first
    gone = found.where(~stays).select("doc_id", "text_hash").distinct()
    repeated = found.where(stays & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_hash").count().where("count > 1")

    def matching(which: DataFrame, how: str) -> DataFrame:
        match = F.col(key).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash"))
        return rows.join(broadcast_if_small(which), match, how)

    repeated = materialize(repeated.select("doc_id", "text_hash"), "repeated")
    if not repeated.limit(1).count():
        return matching(gone, "left_anti").toDF(*docs.columns)
    out = matching(gone.union(repeated), "left_anti").union(matching(repeated, "left_semi").dropDuplicates([key, text]))
    return out.toDF(*docs.columns)
