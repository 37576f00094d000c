"""Hashes of words and of word shingles, for whole Arrow columns at a time.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  A word's
64-bit hash is a polynomial over random byte values modulo 2**64, taken from
prefix sums, then mixed; a shingle's hash mixes the hashes of its words in order.
Two different shingles share a hash with probability of about 2**-64, which is
taken as never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes that are hashed, and searched for words, at a time.
_BLOCK, _SCAN = 1 << 16, 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_rng.integers(1, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far; of more than ``most`` none are kept."""

    up = down = np.ones(1, np.uint64)
    most = 4 * _BLOCK

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.most:
            return _powers(_BASE, n), _powers(_INVERSE, n)
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each text begins in them, with the end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a column begin and end, found a block of bytes at a time."""
    starts, ends = [], []
    inside = False
    for low in range(0, len(data), _SCAN):
        word = ~_SPACE[data[low : low + _SCAN]]
        before = np.concatenate(([inside], word[:-1]))
        inside = bool(word[-1])
        edge = np.zeros(len(word), bool)
        first, last = np.searchsorted(offsets, (low, low + len(word)))
        edge[offsets[first:last] - low] = True
        starts.append(low + np.flatnonzero(word & (edge | ~before)))
        ends.append(low + np.flatnonzero(before & (edge | ~word)))
    if inside:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate((none, *starts)), np.concatenate((none, *ends))


def _long_hash(word: np.ndarray) -> int:
    """The sum that makes a word's hash, a block at a time."""
    total, power = 0, 1
    step = pow(_BASE, _BLOCK, 2**64)
    for low in range(0, len(word), _BLOCK):
        part = _VALUES[word[low : low + _BLOCK]]
        total += int((part * _Powers.get(len(part))[0]).sum(dtype=np.uint64)) * power
        power = power * step % 2**64
    return total % 2**64


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the first word of each text, with the end."""
    data, offsets = _bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_bounds(data, offsets)
    hashes = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _BLOCK)
    for k in long.tolist():
        hashes[k] = np.uint64((_long_hash(data[starts[k] : ends[k]]) + int(ends[k] - starts[k]) * int(_STEPS[SHINGLE])) % 2**64)
    first = 0
    while first < len(starts):  # blocks bound the memory for one very long text
        if ends[first] - starts[first] > _BLOCK:
            first += 1
            continue
        last = int(np.searchsorted(starts, starts[first] + _BLOCK))
        after = np.searchsorted(long, first)
        last = min(last, int(long[after])) if after < len(long) else last
        low, high = starts[first], ends[last - 1]
        up, down = _Powers.get(high - low)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data[low:high]] * up, dtype=np.uint64)))
        s, e = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEPS[SHINGLE]
        first = last
    return _mixed(hashes), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; one for the whole of a short text; none without words."""
    words, at = word_hashes(texts)
    n = len(words) - SHINGLE + 1
    if n > 0:
        grams = words[:n] * _STEPS[0]
        for k in range(1, SHINGLE):
            grams = _mixed(grams) + words[k : n + k] * _STEPS[k]
        grams = _mixed(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = _mixed(h) + words[k : k + 1] * _STEPS[k - a]
            yield _mixed(h + _U(1))
        else:
            yield words[:0]
