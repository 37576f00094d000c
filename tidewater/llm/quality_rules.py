"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything here is a built-in column expression; the operator adds no exchange.

Cases: a null or empty text has no words, so every count is 0 and the document
fails the base rule.  A null id is carried through.  Repeated rows give repeated
results.  Extra columns are ignored by :func:`measure` and kept by :func:`judge`
under their own names unless they clash with a name that the operator adds, in
which case the operator's column takes the place of the old one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for with on as by this from or be are was an a at "
    "der die das und ein eine in den von zu mit sich ist nicht auf für im dem des "
    "le la les de et en un une des du que qui est pour dans sur par pas au "
    "el los las y es por con una su al del se lo"
).split()

#: Function words of other languages in Latin script, of which a long text needs one as well.
OTHER_STOP_WORDS = (
    "não uma os dos das não são mais che di il della per non sono una het een van dat niet met zijn och att som är på inte "
    "og det ikke af til på hän oli myös mutta sekä się nie jest że przez oraz které jsou jako nebo aby și pe cu care sunt este "
    "és hogy nem egy vagy bir ve bu için ile olarak dan yang dengan untuk ini và của là có được không na ya wa kwa katika "
    "ng ang mga sa ja ei et kas ir kad uz un bet je su koji nije amb els les és dhe të për agus tá"
).split()


#: Scripts that are written without spaces between words.
UNSPACED = "Han Hiragana Katakana Thai Lao Khmer Myanmar".split()
#: Longest mean word of a text in another script.
LONGEST_MEAN = 14.0


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.  Bounds are wide: a rule rejects what can't be prose.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, LONGEST_MEAN),
    Rule("symbol_ratio", None, 0.10),
    Rule("exclamation_ratio", None, 0.30),
    Rule("distinct_ratio", 0.10, None),
    Rule("dup_line_ratio", None, 0.50),
    Rule("words_per_line", 1.5, None),
    Rule("stop_or_long", 1, None),
)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _joined(name: str, shift: int) -> Column:
    """Each hash of an array combined with the one ``shift`` places later; the last few have no partner."""
    return F.zip_with(name, F.slice(name, F.lit(shift + 1), F.size(name) + 1), lambda a, b: F.xxhash64(a, b))


def measure(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and ratios of every whole text, beside the key columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keys, body.alias("_t"), words_of(body).alias("_w"))
    df = df.select(
        *keys,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).alias("_bangs"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        # Where words aren't told apart by spaces, their mean length says nothing.
        ((F.length(F.array_join("_w", "")) > LONGEST_MEAN * F.size("_w")) & (2 * F.regexp_count(
            "_t", F.lit("[" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "]")) > F.regexp_count("_t", F.lit(r"\p{L}")))).alias("_unspaced"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS))).alias("_stops"),
        # Word lists have no stop words: only long texts need one, in any case, and only where most letters are Latin.
        F.when(F.size("_w") < 50, True)
        .when(F.exists("_w", lambda w: F.lower(w).isin(*STOP_WORDS, *OTHER_STOP_WORDS)), True)
        .otherwise(2 * F.regexp_count("_t", F.lit(r"\p{IsLatin}")) <= F.regexp_count("_t", F.lit(r"\p{L}"))).alias("_excused"),
    )
    # Hashes of windows of 2 and then 4 words.  A window of 8 can only recur where one of 4 does,
    # so only texts with a recurring window of 4 pay for the windows of 8 and the sort.
    df = df.select("*", _joined("_h", 1).alias("_g2"))
    df = df.select("*", _joined("_g2", 2).alias("_g4"))
    df = df.select("*", F.slice("_g4", 1, F.greatest(F.size("_g4") - 3, F.lit(0))).alias("_f4"))
    df = df.select(
        "*",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_h")).alias("_distinct"),
        F.when(
            F.size(F.array_distinct("_f4")) < F.size("_f4"),
            F.slice(_joined("_g4", 4), 1, F.greatest(F.size("_g4") - (WINDOW - 1), F.lit(0))),
        ).otherwise(F.array().cast("array<long>")).alias("_g"),
    )
    df = df.select(
        "*",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")).alias("_p"),
    )
    repeated = F.filter(
        "_p",
        lambda x, i: F.coalesce((i > 0) & (F.get("_p", i - 1)["g"] == x["g"]), F.lit(False))
        | F.coalesce(F.get("_p", i + 1)["g"] == x["g"], F.lit(False)),
    )
    df = df.select("*", F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("_r"))
    covered = F.aggregate(
        "_r",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda acc: acc["n"],
    )
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        "n_lines",
        F.when(F.col("_unspaced"), F.lit(LONGEST_MEAN)).otherwise(F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("_bangs") / n).alias("exclamation_ratio"),
        (F.col("_distinct") / F.least(n, F.lit(200))).alias("distinct_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_words") / lines).alias("words_per_line"),
        (F.col("_stops") / n).alias("stop_ratio"),
        F.when((F.col("_stops") > 0) | F.col("_excused"), 1).otherwise(0).alias("stop_or_long"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for the whole table."""
    out = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            out = out & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            out = out & (F.col(rule.measure) <= rule.high)
    return out


def quality_rules(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measure(docs, text, keys)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )
