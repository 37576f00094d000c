"""Line dedup by a log-template tree of fixed depth.

A line's place in the tree is its token count, then its first ``DEPTH`` tokens,
where a token with a digit counts as the wildcard ``<*>``.  Below that:

* lines with the same tokens, digits masked, have one template;
* among the lines of a leaf, a token is constant at its position if it occurs there in
  a number of texts; the other tokens are variable fields.  Lines that agree in the constant
  tokens, and have at least ``similarity`` of their tokens without digits constant, have one
  template.  The number is tried from as many texts as make a template up by doubling, so a
  template is found whatever its share of the leaf, if some number lies between its texts and
  those of any value of its fields.

A line with a digit of which less than two tokens, or less than half, are without digits says
little once it is masked - rows of figures, dates - so it only recurs with lines that are equal
to it but for case, digits included, and has no other template.

A template that occurs in ``min_docs`` different texts is recurring - one of ``LONG``
tokens or more, which no two texts have by chance, in ``long_min_docs`` - and its lines
are dropped, but for those of the text in which it comes first (smallest id, then
smallest text hash).  Copies of one text count once, so a document that is merely
copied keeps its lines; deciding between copies is left to document dedup.  With ``near``, the same holds for near
copies: a text that is to lose half of itself or more to one other text, and whose word shingles are alike in at least ``near``
percent, loses nothing to that text.

With ``passages``, runs of lines that have ``LONG`` tokens together, or one such line, are also
dropped if they stand word for word in two texts, again but for the first of these.

Everything is built-in expressions.  Counts are combined before each exchange;
texts are dealt once, at the end, for documents that lose lines.

Cases: blank lines are kept and never counted.  A null text stays null, an empty
one empty.  A text whose lines all go becomes empty; its row stays.  Repeated rows
are treated alike.  Long texts are split into lines whole, and a long line is one row.  Other columns are kept, whatever
their names; ids may be null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import materialize, scratch

DEPTH = 2
MIN_DOCS = 8
LONG, LONG_MIN_DOCS = 50, 3
SIMILARITY = 0.7
WILDCARD = "<*>"
#: Writes a table that is gone when the operator ends.
Keep = Callable[[DataFrame, str], DataFrame]


def _spaced(text: Column) -> Column:
    """A text whose lines have single spaces for blanks; the spaces at a line's ends are left to trim."""
    odd = F.contains(text, F.lit("  ")) | text.rlike("[\t\x0b\x0c\r]")
    return F.when(odd, F.regexp_replace(text, "[ \t\x0b\x0c\r]+", " ")).otherwise(text)


def _lines(docs: DataFrame, text: str, key: str, min_docs: int, long_min_docs: int) -> DataFrame:
    """A row for each line that isn't blank: id, text hash, number among all lines and among these, leaf, hashes of the
    template and of the line, size, texts needed, tokens.

    Each step's columns are used more than once in the next, so Spark keeps the steps apart and computes them once.
    """
    df = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    # Most texts need nothing but this one search.
    df = df.select("*", (F.contains("_t", F.lit("  ")) | F.col("_t").rlike("[0-9\t\x0b\x0c\r]")).alias("_odd"))
    body = F.when(F.col("_odd"), _spaced(F.col("_t"))).otherwise(F.col("_t"))
    lines = F.transform(F.split(body, "\n", -1), lambda x, n: F.struct(F.trim(x).alias("_r"), n.alias("_n")))
    df = df.select("_id", "_h", "_odd", F.octet_length(body).alias("_whole"), F.posexplode(F.filter(lines, lambda x: x["_r"] != "")).alias("_k", "_line"))
    df = df.select("_id", "_h", "_odd", "_whole", "_k", "_line._n", "_line._r")
    df = df.select("*", F.octet_length("_r").alias("_bytes"), F.xxhash64("_r").alias("_raw"), F.xxhash64(F.lit(1), "_r").alias("_raw2"), (F.col("_odd") & F.col("_r").rlike("[0-9]")).alias("_digits"))
    # In _s, a token with a digit is the wildcard.
    df = df.select("*", F.when(F.col("_digits"), F.regexp_replace("_r", "[^ ]*[0-9][^ ]*", WILDCARD)).otherwise(F.col("_r")).alias("_s"))
    size = F.octet_length("_s") - F.octet_length(F.replace("_s", F.lit(" "), F.lit(""))) + 1
    df = df.select("*", size.cast("int").alias("_size"))
    left = F.col("_size") - (F.length("_s") - F.length(F.replace("_s", F.lit(WILDCARD), F.lit("")))) / len(WILDCARD)
    df = df.select("*", F.when(F.col("_digits"), (left < 2) | (2 * left < F.col("_size"))).otherwise(F.lit(False)).alias("_few"))
    leaf = F.xxhash64("_size", F.substring_index("_s", " ", DEPTH))
    need = F.when(F.col("_size") >= LONG, long_min_docs).otherwise(min_docs)
    full = F.when(F.col("_few"), F.xxhash64(F.lit("figures"), F.lower("_r"))).when(F.col("_digits"), F.xxhash64("_s")).otherwise(F.col("_raw"))
    return df.select("_id", "_h", "_n", "_k", "_whole", "_bytes", leaf.alias("_leaf"), full.alias("_full"), "_raw", "_raw2", "_size", need.alias("_min"), "_few", "_s")


def _recurring(rows: DataFrame, template: str) -> DataFrame:
    """Templates of at least ``_min`` texts, and the hash of the text that keeps its lines."""
    by_text = rows.groupBy(template, "_h").agg(F.min("_id").alias("_id"), F.min("_min").alias("_min"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_h")))
    return (
        by_text.groupBy(template).agg(F.count(F.lit(1)).alias("_docs"), first["_h"].alias("_keeper"), F.min("_min").alias("_min"))
        .where("_docs >= _min").select(template, "_keeper")
    )


def _passages(lines: DataFrame, keep: Keep) -> DataFrame:
    """``_h, _n, _keeper``: the lines of each run of ``LONG`` tokens that an earlier text has, too, and that text.

    ``lines`` are those that several texts have: of others no such run can be made.
    """
    # Equal rows count once; the counts are combined before the exchange.
    one = lines.groupBy("_h", "_k").agg(*(F.first(c).alias(c) for c in ("_n", "_raw", "_raw2", "_size")), F.min("_id").alias("_id"))
    # Lines that follow one another have one difference of number and rank.
    one = one.select("*", (F.col("_k") - F.row_number().over(W.partitionBy("_h").orderBy("_k"))).alias("_block"))
    one = one.select("*", F.sum("_size").over(W.partitionBy("_h", "_block").orderBy("_k")).alias("_end"))
    one = one.select("*", (F.col("_end") - F.col("_size")).alias("_start"))
    # The shortest runs that begin and that end with a line: these cover all lines of any longer run.
    after = W.partitionBy("_h", "_block").orderBy("_start").rangeBetween(0, LONG - 1)
    before = W.partitionBy("_h", "_block").orderBy("_end").rangeBetween(1 - LONG, 0)
    ways = [
        F.struct(
            # 128 bits: two texts are enough for a passage, so chance must have no part in it.
            F.struct(*(F.xxhash64(F.collect_list(c).over(w)).alias(c) for c in ("_raw", "_raw2"))).alias("_run"), F.sum("_size").over(w).alias("_len"),
            F.min("_n").over(w).alias("_from"), F.max("_n").over(w).alias("_last"),
        )
        for w in (after, before)
    ]
    runs = one.select("_id", "_h", F.array(*ways).alias("_ways")).select("_id", "_h", F.lit(2).alias("_min"), F.explode("_ways").alias("_way"))
    runs = runs.select("_id", "_h", "_min", "_way.*")
    runs = keep(runs.where(F.col("_len") >= LONG).drop("_len"), "runs")
    found = keep(_recurring(runs, "_run"), "passages")
    again = runs.join(broadcast_if_small(found), "_run").where(F.col("_h") != F.col("_keeper"))
    # Lines between two of a run are blank or part of it.
    return again.select("_h", F.explode(F.sequence("_from", "_last")).alias("_n"), "_keeper").distinct()


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``_h, _set`` from ``_h, _t``: hashes of a text's distinct runs of five words; of all its words if these are fewer."""
    words = F.split(F.trim(F.regexp_replace(F.lower("_t"), r"[\x20\x09-\x0D]+", " ")), " ")
    hashed = texts.select("_h", F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(5))))
    return hashed.select("_h", F.when(F.size("_w") < 5, F.array(F.xxhash64("_w"))).otherwise(F.array_distinct(runs)).alias("_set"))


def _near_copies(docs: DataFrame, text: str, gone: DataFrame, sizes: DataFrame, near: int, keep: Keep) -> DataFrame:
    """``_h, _keeper``: texts that would lose at least half of themselves to one that they are near copies of.

    Each text is compared with those that keep its lines only, and by whole sets of shingles.
    """
    lost = gone.join(sizes, ["_h", "_n"]).groupBy("_h", "_keeper").agg(F.sum("_bytes").alias("_lost"), F.max("_whole").alias("_whole"))
    pairs = keep(lost.where("2 * _lost >= _whole").select("_h", "_keeper"), "pairs")
    names = keep(pairs.select("_h").union(pairs.select("_keeper")).distinct(), "paired-texts")
    texts = docs.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).join(broadcast_if_small(names), "_h")
    sets = keep(_shingle_sets(texts.dropDuplicates(["_h"])), "sets")
    # Few texts keep lines that many have.
    first = pairs.select(F.col("_keeper").alias("_h")).distinct().join(sets, "_h").select(F.col("_h").alias("_keeper"), F.col("_set").alias("_first"))
    both = pairs.join(sets, "_h").join(broadcast_if_small(keep(first, "first-sets")), "_keeper")
    shared = F.size(F.array_intersect("_set", "_first"))
    alike = 100 * shared >= near * (F.size("_set") + F.size("_first") - shared)
    return keep(both.where(alike).select("_h", "_keeper"), "near-copies")


def _constants(lines: DataFrame) -> DataFrame:
    """``_w, _c``: tokens that stand at their place in enough texts, and in how many."""
    # A text's tokens as one array, so that rows are dealt by text and counts are combined before they are dealt by token.
    texts = lines.groupBy("_h", "_min").agg(F.array_distinct(F.flatten(F.collect_set("_tokens"))).alias("_tokens"))
    counts = texts.select("_min", F.explode("_tokens").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_c"), F.min("_min").alias("_min"))
    return counts.where("_c >= _min").select("_w", "_c")


def recurring_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_docs: int = MIN_DOCS,
    long_min_docs: int = LONG_MIN_DOCS,
    similarity: float = SIMILARITY,
    passages: bool = False,
    near: int | None = None,
) -> DataFrame:
    """``_id, _h, drop``: for each text that loses lines, the numbers of these lines; a written table."""
    with scratch(docs.sparkSession) as keep:
        with scratch(docs.sparkSession) as early:
            lines = early(_lines(docs, text, key, min_docs, long_min_docs), "lines")
            slim = lines.drop("_s", "_few")
            # Most lines are of one text only: what is done with the others works on few rows.
            several = slim.groupBy("_full").agg(F.count(F.lit(1)).alias("_rows"), F.min("_h").alias("_a"), F.max("_h").alias("_b"))
            several = early(several.where("_a < _b").select("_full", "_rows"), "several")
            shared = keep(slim.join(broadcast_if_small(several), "_full"), "shared-lines")
            exact = keep(_recurring(shared.where("_rows >= _min"), "_full"), "templates")
            leaves = slim.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_rows"), F.min("_min").alias("_least"))
            leaves = early(leaves.where("_rows >= _least").select("_leaf"), "leaves")

            # Lines of busy leaves without an exact template: find constant tokens, mask the rest, count again.
            open_lines = lines.join(broadcast_if_small(leaves), "_leaf").join(
                broadcast_if_small(exact.select("_full")), "_full", "left_anti"
            )
            # A token with its place in the tree as one number; wildcards have none.
            place = F.transform(F.split("_s", " "), lambda t, i: F.when(t != WILDCARD, F.xxhash64("_leaf", i, t)))
            place = F.when(F.contains("_s", F.lit(WILDCARD)), F.filter(place, lambda w: w.isNotNull())).otherwise(place)
            # Lines of figures get no tokens; a filter Spark would put before the joins with all that it takes to compute.
            place = F.when(~F.col("_few"), place)
            at = keep(open_lines.select("_id", "_h", "_n", "_whole", "_bytes", "_leaf", "_min", place.alias("_tokens")), "open-lines")
        at = at.where("size(_tokens) > 0")
        constants = keep(_constants(at), "constants")
        # A line of a text is one group, however many rows have the text; a set, so that these add nothing.
        masked = (
            at.select("_id", "_h", "_n", "_leaf", "_min", F.size("_tokens").alias("_words"), F.explode("_tokens").alias("_w"))
            .join(broadcast_if_small(constants), "_w")
            .groupBy("_h", "_n", "_leaf", "_min", "_words")
            .agg(F.min("_id").alias("_id"), F.sort_array(F.collect_set(F.struct("_w", "_c"))).alias("_tok"))
        )
        most = F.array_max(F.transform("_tok", lambda t: t["_c"]))
        steps = F.sequence(F.lit(0), F.floor(F.log2(most / F.col("_min"))).cast("int"))
        sets = F.transform(steps, lambda k: F.filter("_tok", lambda t: t["_c"] >= F.pow(F.lit(2.0), k) * F.col("_min")))
        sets = F.filter(sets, lambda x: F.size(x) >= similarity * F.col("_words"))
        masks = F.array_distinct(F.transform(sets, lambda x: F.xxhash64("_leaf", x)))
        masked = masked.select("_id", "_h", "_n", "_min", F.explode(masks).alias("_mask"))
        masked = keep(masked, "masked-lines")
        general = _recurring(masked, "_mask")

        def lost(rows: DataFrame, found: DataFrame, template: str) -> DataFrame:
            return rows.join(broadcast_if_small(found), template).where(F.col("_h") != F.col("_keeper"))

        line = ["_h", "_n", "_keeper"]
        gone = lost(masked, keep(general, "templates"), "_mask").select(line)
        whole = lost(shared, exact, "_full").select("_id", *line)
        if passages:
            gone = gone.union(_passages(shared, keep))
        if near is not None:
            either = keep(gone.union(whole.select(line)).distinct(), "lost-lines")
            sizes = shared.select("_h", "_n", "_bytes", "_whole").union(at.select("_h", "_n", "_bytes", "_whole")).distinct()
            copies = broadcast_if_small(_near_copies(docs, text, either, sizes, near, keep))
            gone, whole = (x.join(copies, ["_h", "_keeper"], "left_anti") for x in (gone, whole))
        # All rows of a text lose the same lines.
        texts = shared.select("_id", "_h").union(at.select("_id", "_h")).distinct()
        gone = texts.join(gone.select("_h", "_n").distinct(), "_h").select("_id", "_h", "_n")
        gone = gone.union(whole.select("_id", "_h", "_n"))
        return materialize(gone.groupBy("_id", "_h").agg(F.collect_set("_n").alias("drop")), "dropped-lines")


def _without(docs: DataFrame, text: str, key: str, **options) -> DataFrame:
    """``docs`` by the places of its columns, ``c0, c1, ...``, with ``text`` cut, and the numbers of the lines that went as ``_drop`` (null: none)."""
    codes = [f"c{k}" for k in range(len(docs.columns))]
    text, key = (codes[docs.columns.index(name)] for name in (text, key))
    rows = docs.toDF(*codes)
    cuts = recurring_lines(rows, text, key, **options).select("_id", "_h", F.col("drop").alias("_drop"))
    match = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h"))
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("_drop", i))
    body = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return rows.join(cuts, match, "left").withColumn(text, body).select(*codes, "_drop")


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all its columns; ``text`` without the lines of recurring templates."""
    return _without(docs, text, key, **options).drop("_drop").toDF(*docs.columns)


def line_report(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for each row: its lines, how many went, and the text without them."""
    n_lines = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).cast("long")
    slim = docs.select(F.col(key).alias("doc_id"), n_lines.alias("n_lines"), F.col(text).alias("text"))
    out = _without(slim, "text", "doc_id", **options).toDF("doc_id", "n_lines", "text", "_drop")
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")
    return out.select("doc_id", "n_lines", dropped.alias("n_dropped"), "text")
