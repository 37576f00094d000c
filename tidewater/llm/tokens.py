"""Token ids by a ready tokenizer file, looked up for whole columns of pieces.

The tokenizer splits a text into pieces before it merges bytes, and a piece's ids
don't depend on its neighbours.  So a batch of texts is cut into pieces as one array
of characters, pieces are told apart by a 64-bit hash, and the tokenizer only sees
those that a worker hasn't met; two pieces share a hash with a probability of about
2**-64, which is taken as never.  Only texts whose characters are below U+0180 go this
way, where lower-casing and the character classes of the pattern are plain to state;
any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from tidewater.llm.shingles import _mixed, _Powers

#: The pre-tokenizer's classes for characters below U+0180; white space as the tokenizer has it.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r  "
#: Endings after an apostrophe that are a piece with it.
_ENDINGS = "s t re ve m ll d".split()
#: Characters that send a text to the tokenizer whole: U+0085, the dotted capital I, all from U+0180.
_OTHER = re.compile("[^\u0000-\u0084\u0086-įı-ſ]|<\\|")
#: Where a text can be cut: white space, or between two pieces whatever is around them.
_GAP = re.compile(f"(?P<space>[{_SPACE}])|(?<=[{_NUMBER}])|(?=[{_NUMBER}])|(?<=[{_LETTER}])(?=[^{_LETTER}{_NUMBER}{_SPACE}])|(?<=[^'{_LETTER}{_NUMBER}{_SPACE}])(?=[{_LETTER}])")
#: Pieces kept in a Python worker; characters hashed at a time, and looked up at a time.
_KEPT, _PART, _BATCH = 1_000_000, 1 << 17, 1 << 19

_IS_SPACE, _IS_LETTER, _IS_NUMBER, _IS_SIGN = range(4)
_KIND = np.array(
    [
        _IS_SPACE if re.match(f"[{_SPACE}]", c) else _IS_LETTER if re.match(f"[{_LETTER}]", c)
        else _IS_NUMBER if re.match(f"[{_NUMBER}]", c) else _IS_SIGN
        for c in map(chr, range(0x180))
    ],
    np.uint8,
)
_VALUES = np.random.default_rng(20240301).integers(1, 2**63, 0x180, dtype=np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``_PART`` characters, cut at white space or between two pieces."""
    start = 0
    while len(text) - start > _PART:
        gap = _GAP.search(text, start + _PART)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def piece_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-cased characters begin and end."""
    kind = _KIND[codes]
    begin = np.empty(len(kind), bool)
    begin[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == _IS_NUMBER
    word = kind != _IS_SPACE
    begin &= word
    # An apostrophe that begins a run of signs, with one of the endings behind it, is a piece with that ending.
    marks = np.flatnonzero(begin & (codes == ord("'")))
    after = np.concatenate((codes, np.zeros(3, codes.dtype)))
    for ending in _ENDINGS:
        here = marks[np.logical_and.reduce([after[marks + 1 + k] == ord(c) for k, c in enumerate(ending)])]
        begin[here + 1] = False
        rest = here + 1 + len(ending)
        rest = rest[rest < len(kind)]
        begin[rest] |= kind[rest] == _IS_LETTER
    last = word.copy()
    last[:-1] &= begin[1:] | ~word[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _blocks(parts: list[str]) -> Iterator[list[str]]:
    """Parts in order, about ``_PART`` characters together."""
    block, size = [], 0
    for part in parts:
        if block and size + len(part) > _PART:
            yield block
            block, size = [], 0
        block.append(part)
        size += len(part) + 1
    if block:
        yield block


class _Block:
    """Pieces of some texts: their hashes, and how many each text has."""

    def __init__(self, parts: list[str]):
        self.text = "\n".join(parts)
        codes = np.frombuffer(self.text.encode("utf-16-le"), np.uint16)
        self.starts, self.ends = piece_bounds(codes)
        up, down = _Powers.get(len(codes))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[codes] * up, dtype=np.uint64)))
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + length * _LENGTH)
        self.counts = np.diff(np.searchsorted(self.starts, np.cumsum([0, *(len(p) + 1 for p in parts)])))

    def piece(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]]


class _Known:
    """Ids of the pieces that a worker has met, by the order of their hashes."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each, and whether it is known."""
        at = np.searchsorted(self.hashes, hashes)
        return at, (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, at: np.ndarray, pieces: list[str]) -> None:
        """Pieces with rising hashes that :meth:`find` places before those at ``at``."""
        made = self.encode(pieces)
        size = np.array([len(x) for x in made], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, *made))
        self.hashes, self.first, self.size = (
            np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.first, first), (self.size, size))
        )


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str) -> Callable[[Iterable[str | None]], list[np.ndarray]]:
    """A function from texts to their ids; one for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import pandas as pd
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    ends_piece = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_piece[[k for token, k in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def ids_at_once(pieces: list[str]) -> list[np.ndarray]:
        """A piece's last token, and no other of it, has the word end."""
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        out = np.split(ids, np.flatnonzero(ends_piece[ids])[:-1] + 1)
        if len(out) != len(pieces):
            raise ValueError("this tokenizer's tokens don't tell where a piece ends")
        return out

    known = _Known(ids_at_once)

    def ids_of(parts: list[str]) -> list[np.ndarray]:
        """Ids of lower-cased texts."""
        blocks = [_Block(block) for block in _blocks(parts)]
        hashes = np.concatenate([b.hashes for b in blocks])
        which, distinct = pd.factorize(hashes)
        if len(known.hashes) > _KEPT:
            known.clear()
        order = np.argsort(distinct)
        keys = distinct[order]
        at, there = known.find(keys)
        if not there.all():
            where = np.empty(len(keys), np.int64)
            where[which] = np.arange(len(which))
            where = where[order[~there]]
            lows = np.cumsum([0, *(len(b.hashes) for b in blocks)])
            block = np.searchsorted(lows, where, "right") - 1
            known.add(keys[~there], at[~there], [blocks[k].piece(j) for k, j in zip(block.tolist(), (where - lows[block]).tolist())])
            at, _ = known.find(keys)
        places = np.empty(len(keys), np.int64)
        places[order] = at
        places = places[which]
        size, first = known.size[places], known.first[places].astype(np.int64)
        after = np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))
        ids = known.ids[np.repeat(first - after[:-1], size) + np.arange(after[-1])]
        cuts = after[np.cumsum(np.concatenate(([0], *(b.counts for b in blocks))))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(texts: Iterable[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = []
        waiting: list[tuple[int, str]] = []

        def flush() -> None:
            for (k, _), ids in zip(waiting, ids_of([part for _, part in waiting]) if waiting else ()):
                out[k].append(ids)
            waiting.clear()

        size = 0
        for k, text in enumerate(texts):
            text = text or ""
            out.append([])
            if (not text.isascii() or "<|" in text) and _OTHER.search(text):
                whole = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
                out[k].append(np.array(whole.ids, np.uint32))
                continue
            for part in _parts(text.lower()):
                if len(part) > 4 * _PART:  # one piece, which needn't be known again
                    flush()
                    size = 0
                    out[k].append(np.array(tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32))
                    continue
                if size + len(part) > _BATCH:
                    flush()
                    size = 0
                waiting.append((k, part))
                size += len(part) + 1
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    return encode
