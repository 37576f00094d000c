"""Periodic runs of words, by maximal pairs of each text's suffixes.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Let l be the
length that the suffixes at i and i + q have in common: if the words before them differ and so do the
words after l, they are a maximal pair, and i .. i + q + l is a stretch of period q that nothing
extends.  So the maximal pairs whose distance is at most a third of l are exactly the runs of four periods or
more, each with its start, its end and its period at once.  Multiples of a run's period give the same
stretch; the smallest distance of a stretch is its period.

A task works on many texts at a time, as one array of word numbers:

1. The suffixes are ordered by prefix doubling: positions are told apart by 1, 2, 4, ... words, and only those
   that aren't yet are sorted again.  Words get another number in each text, so texts never mix.
2. A pair of common length from k to 2k lies in one class of k words, at a distance below 2k / 3.  Positions
   without such a neighbour for any k are in no pair and are left out; most texts end here.
3. Common lengths of neighbouring suffixes follow from the classes, from the longest to the shortest.
4. The intervals of equal common length are visited from the deepest up.  Each keeps its positions in order, with
   the word to the left as their class; when two children meet, each position of the smaller one looks for
   partners of another class in the larger one.  Within a third of l two positions of one node are a multiple of
   the stretch's period apart, so of all below a position only the lowest can have another class, and
   those above have one class together: two searches find all its pairs.

There are at most as many pairs as the exponents of all runs add up to, so the work is linear but for sorting.

Cases: a null or empty text has no words and no runs.  Rows are handled each by itself, so repeated rows
and ids have equal results.  Without an id a text isn't altered by :func:`altered`.  A long text is worked on whole; memory is about 100 bytes a
word, and 8 more for each doubling of words that repeat.  Empty tables give empty results.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.arrow import chunks, column, map_arrow

#: A run has so many words and so many periods at least; a pair's distance is then at most a part of its common length.
LEAST, PERIODS = 6, 4
#: The shortest common length of a pair: that of a run of one word.
_SHORTEST = LEAST - 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column, and where each text's begin among them, with the end."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, edges = parts.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return words.filter(full), before[edges].astype(np.int64)


def altered(ids: list[int | None], edges: np.ndarray) -> np.ndarray | None:
    """For each word the number of the word that takes its place: every tenth text, by its id, repeats itself from some word on."""
    out = None
    for k, doc in enumerate(ids):
        first, n = int(edges[k]), int(edges[k + 1] - edges[k])
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 or not n:
            continue
        out = np.arange(edges[-1]) if out is None else out
        g = h // 10
        start = g % n
        period = 1 + (n - start) // (3 + g % 8)
        out[first + start : first + n] = first + start + np.arange(n - start) % period
    return out


class _Classes:
    """Positions that share their first ``k`` words with others, and the number of their class."""

    def __init__(self, k: int, at: np.ndarray, rank: np.ndarray):
        order = np.argsort(at)
        self.k, self.at, self.rank = k, at[order].astype(np.int32), rank[order].astype(np.int32)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The class at each position; -1 where it is alone."""
        found = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return np.where(self.at[found] == at, self.rank[found], -1)


def _suffixes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may be in a pair, in the order of their suffixes, and the length each has in common with the one before."""
    n = len(words)
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words]  # the place of the first suffix of its class
    alone = counts[words] == 1
    at, k = np.flatnonzero(~alone), 1
    levels = [_Classes(1, at, rank[at])]
    near = np.zeros(n, bool)
    while len(at):
        after = at + k
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        order = np.argsort(key, kind="stable")  # in a class, by position
        at, key = at[order], key[order]
        old = key >> 32
        head = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(head)
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        size = np.diff(np.concatenate((heads, [len(at)])))
        base = group[np.searchsorted(group, heads, "right") - 1]
        new = np.repeat(old[heads] + heads - base, size)
        rank[at] = new
        k *= 2
        more = np.repeat(size > 1, size)
        at, new = at[more], new[more]
        if not len(at):
            break
        levels.append(_Classes(k, at, new))
        if 2 * k > _SHORTEST:
            close = (new[1:] == new[:-1]) & (at[1:] - at[:-1] <= (2 * k - 1) // (PERIODS - 1))
            near[at[1:][close]] = True
            near[at[:-1][close]] = True
    order = np.flatnonzero(near)
    order = order[np.argsort(rank[order])]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for level in reversed(levels):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        x, y = level.of(x), level.of(y)
        common[inside & (x >= 0) & (x == y)] += level.k
    return order, common


def _meet(length: int, one: list[int], two: list[int], left: list[int], found: dict[tuple[int, int], int]) -> list[int]:
    """The pairs between two children of a node, whose positions become one list."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    reach, many = length // (PERIODS - 1), len(large)

    def pair(low: int, high: int) -> None:
        key = (low, high + length)
        found[key] = min(found.get(key, high - low), high - low)

    for p in small:
        own, k = left[p], bisect_left(large, p)
        if k:
            low = large[bisect_left(large, p - reach, 0, k)] if large[k - 1] >= p - reach else p
            if low < p and left[low] != own:
                pair(low, p)
        if k < many and large[k] <= p + reach and left[large[k]] != own:
            for high in large[k : bisect_right(large, p + reach, k)]:
                pair(p, high)
    if 8 * len(small) > many:
        large = sorted(large + small)
    else:
        for p in small:
            insort(large, p)
    return large


def _pairs(order: list[int], common: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """The smallest distance of the maximal pairs that make each stretch, by its start and end."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []
    for k, p in enumerate(order):
        length = common[k] if k < len(common) else 0
        mine = [p]
        while stack and stack[-1][0] > length:
            depth, rest = stack.pop()
            mine = _meet(depth, rest, mine, left, found)
        if length < _SHORTEST:
            continue
        if stack and stack[-1][0] == length:
            stack[-1] = (length, _meet(length, stack[-1][1], mine, left, found))
        else:
            stack.append((length, mine))
    return found


def runs(words: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` of all runs, by start, then period; words are numbers, texts lie between ``edges``."""
    sizes = np.diff(edges)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own, _ = pd.factorize(text * (int(words.max(initial=0)) + 1) + words)  # rising with the text
    order, common = _suffixes(own, edges[1:][text])
    if len(order) < 2:
        return np.zeros((0, 3), np.int64)
    left = np.full(len(words), -1)
    left[1:] = own[:-1]
    left[edges[:-1][sizes > 0]] = -1
    left_list: list[int] = left.tolist()
    found = _pairs(order.tolist(), common.tolist(), left_list)
    return np.array(sorted((start, end, period) for (start, end), period in found.items()), np.int64).reshape(-1, 3)


def collapsed_words(edges: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that a run has after its first period."""
    step = np.zeros(int(edges[-1]) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 1], -1)
    return np.cumsum(step[:-1]) == 0


def joined(words: pa.Array, edges: np.ndarray, stay: np.ndarray) -> pa.Array:
    """Each text's words that stay, with single spaces."""
    after = np.concatenate(([0], np.cumsum(stay)))[edges]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(after, pa.int64()), words.filter(pa.array(stay))), pa.scalar(" ", pa.large_string()))


def _of_texts(batch: pa.RecordBatch, alter: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words, edges = split_words(column(batch, "text"))
    source = altered(column(batch, "doc_id").to_pylist(), edges) if alter else None
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if source is not None:
        words, numbers = words.take(pa.array(source)), numbers[source]
    found = runs(numbers, edges)
    return edges, found, joined(words, edges, collapsed_words(edges, found))


def _lists(edges: np.ndarray, found: np.ndarray) -> Iterator[np.ndarray]:
    """The runs of each text, by words of the text."""
    at = np.searchsorted(found[:, 0], edges)
    for first, low, high in zip(edges[:-1].tolist(), at[:-1].tolist(), at[1:].tolist()):
        own = found[low:high]
        yield np.column_stack((own[:, 0] - first, own[:, 1] - own[:, 0], own[:, 2]))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        edges, found, texts = _of_texts(batch, alter=True)
        rows = []
        for own, text in zip(_lists(edges, found), texts):
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
            best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist() if len(own) else [None] * 3
            milli = None if best[0] is None else 1000 * best[1] // best[2]
            rows.append((
                len(own), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.as_buffer()).hexdigest()
            ))
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        made = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows))]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *made], names=["doc_id", *names])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in chunks(batches):
        edges, found, texts = _of_texts(batch, alter=False)
        own = [[dict(zip(("start", "length", "period"), row)) for row in x.tolist()] for x in _lists(edges, found)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(own, kind), texts.cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def _slim(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, runs, collapsed`` for each row: its runs (array of ``start, length, period``, in words), and its words without repeats."""
    return map_arrow(_slim(docs, text, key), _plain, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row, with every tenth text altered: the number of runs, the longest, and digests of all runs and of the text without repeats."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_arrow(_slim(docs, text, key), _report, schema)
