"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its distinct words hashed to ``WORDS`` places, each
with the same share of one unit; statistics of its structure; and its size.
Every feature has a weight and a vector of ``RANK`` values; a pair of features
interacts by the product of their vectors.  The sum over all pairs takes linear
time, as half the difference of the squared sum and the sum of squares.

The machine is fitted by mini-batches with adaptive steps on a bounded sample of
labelled documents, in one task; the fitted parameters have a fixed size.

Cases: a null or empty text has no words and zero statistics, and gets a score
like any other.  Without labels of both classes every score is the same (0.5).
Repeated rows get equal scores; null ids are carried; other columns aren't read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.arrow import chunks, column, map_arrow
from tidewater.llm.labelled import held_out, labelled_sample

#: Labelled documents of each class that are read at most for learning.
PER_CLASS = 3_000
WORDS, RANK = 4096, 6
EPOCHS, BATCH, RATE = 30, 64, 0.05
STATISTICS = (
    "log_words", "log_chars", "mean_word", "symbols", "exclamations", "upper", "digits", "pipes",
    "distinct", "adjacent", "top_word", "dup_lines", "log_line_words", "stops", "beyond_ascii",
)
_CLASSES = {"symbols": b"#*$%&<>", "exclamations": b"!", "upper": bytes(range(65, 91)), "digits": b"0123456789", "pipes": b"|", "stops": b".,;:?"}


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the distinct words, and the statistics, of each text of a column."""
    from tidewater.llm.shingles import _bytes_of, word_hashes

    words, at = word_hashes(texts)
    data, offsets = _bytes_of(texts)
    sums = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        sums[name] = np.concatenate(([0], np.cumsum(table[data])))[offsets]
    high = np.concatenate(([0], np.cumsum(data > 127)))[offsets]
    space = np.concatenate(([0], np.cumsum(np.isin(data, np.array([9, 10, 11, 12, 13, 32], np.uint8)))))[offsets]
    for k, text in enumerate(texts.to_pylist()):
        own = words[at[k] : at[k + 1]]
        n, size = len(own), int(offsets[k + 1] - offsets[k])
        distinct, counts = np.unique(own, return_counts=True)
        lines = [x for x in (text or "").split("\n") if x.strip()]
        chars = max(1, size - int(space[k + 1] - space[k]))
        per = max(1, n)
        share = {c: int(v[k + 1] - v[k]) for c, v in sums.items()}
        stats = [
            np.log1p(n) / 10, np.log1p(size) / 12, min(chars / per, 30) / 10, min(share["symbols"] / per, 3),
            min(share["exclamations"] / per, 3), min(share["upper"] / chars * 4, 3), min(share["digits"] / chars * 4, 3),
            min(share["pipes"] / per, 3), np.log1p(len(distinct)) / max(1.0, np.log1p(n)),
            3 * float((own[1:] == own[:-1]).sum()) / per, float(counts.max()) / per * 3 if n else 0.0,
            2 * (1 - len(set(lines)) / len(lines)) if lines else 0.0, np.log1p(n / max(1, len(lines))) / 8,
            min(share["stops"] / per, 3), float(high[k + 1] - high[k]) / chars * 4,
        ]
        yield np.unique(distinct % np.uint64(WORDS)).astype(np.int64), np.array(stats, np.float64)


class Machine:
    """Parameters: a bias, a weight and a vector for each place; statistics come after the words."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    @classmethod
    def new(cls) -> "Machine":
        rng = np.random.default_rng(7)
        size = WORDS + len(STATISTICS)
        return cls(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))

    def row(self, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a document's features."""
        place = np.concatenate((words, np.arange(WORDS, WORDS + len(stats))))
        return place, np.concatenate((np.full(len(words), 1.0 / max(1, len(words))), stats))

    def raw(self, place: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        """The margin, and the sum of the scaled vectors, which the gradient needs too."""
        scaled = self.vectors[place] * value[:, None]
        total = scaled.sum(axis=0)
        pairs = 0.5 * float((total**2).sum() - (scaled**2).sum())
        return self.bias + float(self.weights[place] @ value) + pairs, total

    def score(self, words: np.ndarray, stats: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(words, stats))[0], -30, 30))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=np.array(self.bias), weights=self.weights.astype(np.float32), vectors=self.vectors.astype(np.float32))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Machine":
        z = np.load(io.BytesIO(data))
        return cls(float(z["bias"]), z["weights"].astype(np.float64), z["vectors"].astype(np.float64))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss, classes weighted alike, small penalties, AdaGrad steps."""
    m = Machine.new()
    if not len(labels) or labels.min() == labels.max():
        return m if not len(labels) else Machine(0.0, m.weights, m.vectors * 0)
    data = [m.row(*r) for r in rows]
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rng = np.random.default_rng(11)
    seen_b, seen_w, seen_v = 1e-6, np.full(len(m.weights), 1e-6), np.full(m.vectors.shape, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            gb, gw, gv = 0.0, np.zeros_like(m.weights), np.zeros_like(m.vectors)
            for i in picked:
                place, value = data[i]
                margin, total = m.raw(place, value)
                d = share[i] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]) / len(picked)
                gb += d
                gw[place] += d * value
                gv[place] += d * value[:, None] * (total - m.vectors[place] * value[:, None])
            gw += 1e-4 * m.weights
            gv += 1e-4 * m.vectors
            seen_b, seen_w, seen_v = seen_b + gb**2, seen_w + gw**2, seen_v + gv**2
            m.bias -= RATE * gb / seen_b**0.5
            m.weights -= RATE * gw / np.sqrt(seen_w)
            m.vectors -= RATE * gv / np.sqrt(seen_v)
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **names: str) -> bytes:
    """The fitted machine; one task reads the bounded sample, and its parameters come to the driver."""
    sample = labelled_sample(docs, labels, "quality", per_class, **names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = list(features(column(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    column(batch, "label"),
                ],
                names=["words", "stats", "label"],
            )

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[sorted(range(len(group)), key=lambda i: (group["label"].iat[i], group["stats"].iat[i].tobytes()))]
        found = [(np.asarray(w, np.int64), np.asarray(s, np.float64)) for w, s in zip(group["words"], group["stats"])]
        return pd.DataFrame({"model": [fit(found, group["label"].to_numpy(np.float64)).dump()]})

    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    made = map_arrow(spread, rows, "words array<long>, stats array<double>, label int")
    one = made.groupBy().applyInPandas(train, "model binary").collect()  # 2 * per_class rows at most
    return bytes(one[0]["model"]) if one else Machine(0.0, *(lambda m: (m.weights, m.vectors * 0))(Machine.new())).dump()


def score(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of each whole text; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(model)
        for batch in chunks(batches):
            scores = [machine.score(*f) for f in features(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(slim, run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **names: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    scored = score(docs, learn(docs, labels, **names), **names)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
