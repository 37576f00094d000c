"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts to Latin ones, joins letters
that are spelled out ("i.d.i.o.t"), reads digits and signs inside words as the
letters they stand for, lower-cases, and turns everything between words into one
space.  One automaton holds the terms - whole words or beginnings of words - and
the exception phrases; a term inside an exception phrase doesn't count.  The
weights of the matched terms, beside their density per word, give the score
through a logistic curve.

The lexicon has a small fixed part, and a part learned from labelled documents:
words and word beginnings that are many times as frequent in toxic documents.
Phrases around a term that only occur in documents that aren't toxic become
exceptions.  The curve is fitted on the same bounded sample.

Cases: a null or empty text has no match and gets the curve's lowest value.
Without labels of both classes the fixed lexicon and a fixed curve are used.
Repeated rows get equal scores; null ids are carried; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.arrow import bound_batches, chunks, column, map_arrow
from tidewater.llm.labelled import held_out, labelled_sample

#: Labelled documents of each class that are read at most for learning.
PER_CLASS = 4_000
#: Shortest and longest word beginnings that are looked at.
_SHORTEST, _LONGEST = 4, 8
#: A learned term is so many times as frequent among the words of toxic documents, occurs in so many
#: of them, and tells the classes of documents apart by so much (twice the log-likelihood ratio).
_RATIO, _LEAST, _EVIDENCE = 8.0, 4, 20.0
#: Terms, and exception phrases, that are learned at most: what the driver holds and sends to the tasks.
_TERMS = 5_000
#: Highest margin of a text without a match.
_NO_MATCH = -1.0

#: General terms of abuse and phrases in which they are harmless.
BASE_TERMS = ("idiot", "moron", "imbecile", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown")
BASE_WEIGHT = 2.0
BASE_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "loser pays", "the idiot by dostoevsky")

#: Letters that look like Latin ones (Cyrillic, Greek, and dotless i).
_LOOK_ALIKE = str.maketrans(
    "аеорсхуіјѕһԁԛԝѵгпкмтвнАЕОРСХУІЈЅНВКМТԌԚԜ" "αεοριυνκτχηωΑΕΟΡΙΥΝΚΤΧΗΜΒΖ" "ıɡɑ",
    "aeopcxyijshdqwvrnkmtbhaeopcxyijshbkmtgqw" "aeopiuvktxnwaeopiynktxhmbz" "iga",
)
#: Signs that stand for letters inside words.
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]")
_WIDE = str.maketrans({c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)})
_FOREIGN = re.compile("[\u0131\u0251\u0261\u0370-\u03ff\u0400-\u052f\uff01-\uff5e]")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*·]){2,}[^\W\d_](?!\w)")
_SIGNED = re.compile(r"[@$]?[^\W_]+(?:[@$!|]+[^\W_]+)*")
_HAS_SIGN = re.compile(r"[013457@$]")
_GAP = re.compile(r"[\W_]+")


def _latin(match: re.Match) -> str:
    """A word with its look-alikes replaced, unless letters of another script are left: then it is a word of that script."""
    word = match[0].translate(_LOOK_ALIKE)
    return match[0] if _FOREIGN.search(word) else word


def _plain(match: re.Match) -> str:
    word = match[0]
    if not _HAS_SIGN.search(word) and "!" not in word and "|" not in word:
        return word
    letters = sum(c.isalpha() for c in word)
    return word.translate(_SIGNS) if 2 * letters >= len(word) else word


def fold(text: str) -> str:
    """Words of letters and digits, folded, each after one space, with a space at the end."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if _FOREIGN.search(text):
            text = text.translate(_WIDE)
            text = re.sub(r"[^\W\d_]+", _latin, text)
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_*·]", "", m[0]), text.lower())
    if _HAS_SIGN.search(text) or "!" in text or "|" in text:
        text = _SIGNED.sub(_plain, text)
    return _GAP.sub(" ", f" {text} ")


@dataclass(frozen=True)
class Model:
    """Terms with weights (a term that ends with a space is a whole word), exceptions, and the curve."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = BASE_EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 20.0)


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.machine, self.curve = ahocorasick.Automaton(), model.curve
        for term, weight in model.terms:
            self.machine.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in model.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.machine.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Begin, end and weight of the terms that count."""
        found, free = [], []
        for end, (length, weight) in self.machine.iter(folded):
            (free if weight is None else found).append((end + 1 - length, end + 1, weight))
        if not free:
            return found
        # The farthest end among exceptions that begin no later than a term tells whether one of them holds it.
        free.sort(key=lambda m: m[0])
        begins, ends = [m[0] for m in free], [*itertools.accumulate((m[1] for m in free), max)]
        return [m for m in found if not (k := bisect_right(begins, m[0])) or ends[k - 1] < m[1]]

    def measures(self, text: str) -> tuple[float, float]:
        """Log of the summed weight, and weight per word."""
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(folded))
        return math.log1p(max(0.0, total)), max(0.0, total) / max(1, folded.count(" ") - 1)

    def score(self, text: str) -> float:
        x, y = self.measures(text)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * x + c * min(y, 1.0)))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of a partition of the sample: documents and places by class."""
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    places: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
            own: Counter = Counter()
            for w, c in Counter(fold(text).split()).items():
                if len(w) >= 3:
                    own[f"{w} "] += c
                for n in range(_SHORTEST, min(_LONGEST, len(w)) + 1):
                    own[w[:n]] += c
            docs[label].update(own.keys())
            places[label].update(own)
    names = [*(docs[0].keys() | docs[1].keys())]
    counts = [pa.array([c[k] for k in names], pa.int64()) for c in (*docs, *places)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["term", "n0", "n1", "c0", "c1"])


def _chosen(weight: dict[str, float]) -> dict[str, float]:
    """The shortest forms: a term whose beginning is a term as well adds nothing."""
    out = {}
    for term, value in weight.items():
        stem = term.rstrip(" ")
        if not any(stem[:n] in weight for n in range(_SHORTEST, len(stem) + (term != stem))):
            out[term] = value
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **names: str) -> Model:
    """A model from labelled documents; what reaches the driver is bounded by the sample and ``_TERMS``."""
    base = {f"{t} ": BASE_WEIGHT for t in BASE_TERMS}
    sample = labelled_sample(docs, labels, "toxic", per_class, **names)
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Model(tuple(base.items()))
    least = max(_LEAST, math.ceil(0.012 * n1))
    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    counted = map_arrow(spread, _features, "term string, n0 long, n1 long, c0 long, c1 long").groupBy("term").agg(
        *(F.sum(c).alias(c) for c in ("n0", "n1", "c0", "c1"))
    )
    places = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    odds = F.log((F.col("c1") + 0.5) / places[1]) - F.log((F.col("c0") + 0.5) / places[0])
    share = F.log(F.col("n1") / (F.col("n1") + F.col("n0")) * (n0 + n1) / n1)
    rows = (
        counted.where(F.col("n1") >= least).withColumn("odds", odds)
        .where((F.col("odds") >= math.log(_RATIO)) & (2 * F.col("n1") * share >= _EVIDENCE))
        .orderBy(F.desc("n1"), "term").limit(_TERMS).collect()
    )
    terms = base | _chosen({r["term"]: r["odds"] for r in rows})
    model = Model(tuple(terms.items()))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two-word phrases that hold a term, with the class of their document."""
        match = Matcher(model)
        for batch in batches:
            phrases, own = [], []
            for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
                folded, found = fold(text), set()
                for begin, end, _ in match.matches(folded):
                    word_end = folded.find(" ", end - 1) if folded[end - 1] != " " else end - 1
                    word = folded[begin + 1 : word_end]
                    found.add(f"{folded[:begin].rpartition(' ')[2]} {word}".strip())
                    found.add(f"{word} {folded[word_end + 1 :].partition(' ')[0]}".strip())
                phrases += (kept := [p for p in found if " " in p])
                own += [label] * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(own, pa.int32())], names=["phrase", "label"])

    phrases = (
        map_arrow(spread, around, "phrase string, label int").groupBy("phrase")
        .agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n"))
        .where("n1 = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(_TERMS).collect()
    )
    model = Model(model.terms, (*BASE_EXCEPTIONS, *(r["phrase"] for r in phrases)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(model)
        for batch in batches:
            pairs = [match.measures(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), column(batch, "label")],
                names=["x", "y", "label"],
            )

    points = map_arrow(spread, measured, "x double, y double, label int").collect()  # 2 * per_class rows at most
    return Model(model.terms, model.exceptions, _curve(np.array(sorted(map(tuple, points)), float)))


def _curve(points: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two measures, classes weighted alike, slopes not negative.

    The level is held down, so that a text without any match never counts as toxic.
    """
    x = np.column_stack((np.ones(len(points)), points[:, 0], np.minimum(points[:, 1], 1.0)))
    y = points[:, 2]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = np.array([1.0, 1.0, 0.05])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x / scale @ w, -30, 30)))
        gradient = (x / scale).T @ (share * (p - y)) + 1e-4 * w
        hessian = ((x / scale) * (share * p * (1 - p))[:, None]).T @ (x / scale) + 1e-4 * np.eye(3)
        w -= np.linalg.solve(hessian, gradient)
        w[0], w[1:] = min(w[0], _NO_MATCH), np.maximum(w[1:], 0.0)
    a, b, c = (w / scale).tolist()
    return (a, b, c)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of each whole text; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(model)
        for batch in chunks(batches):
            scores = [match.score(t or "") for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(slim, run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    scored = score(docs, learn(docs, labels, **names), **names)
    predicted: Column = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; scored in one pass, in place.

    Null and empty texts stay, and so does each of several rows with one id by its own text.
    """
    model = learn(docs, labels, text=text, key=key)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(model)  # once for a task, not for each batch
        for column in columns:
            yield pd.Series([match.score(t or "") for t in column], dtype="float64")

    return docs.where(of(F.col(text)) < threshold)
