"""Vectorised words and shingles of UTF-8 texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. All separators are ASCII, so
cutting bytes cuts no character. Words and shingles are held as 64-bit hashes: a polynomial over random byte values
modulo 2**64, then a bijective mix. Two different shingles of a pair of documents get one hash with a probability of
about (their number)**2 / 2**64, which is below 1e-9 for a hundred thousand shingles.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Odd multipliers of the places in a shingle.
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, n.bit_length())
    if size not in _power:
        _power.clear()
        a, b = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INV, dtype=np.uint64)
        a[0] = b[0] = 1
        _power[size] = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _power[size]


class Words:
    """Words of several texts: hash, document (index in the slice), start and end byte of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1
        n = len(data)
        sep = np.ones(n + 2, dtype=bool)
        sep[1:-1] = _SEP[data]
        change = sep[1:] != sep[:-1]
        cut = offsets[1:-1]  # a text starts a word of its own
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        inner = cut[~(sep[cut] | sep[cut + 1])]
        edge = np.flatnonzero(change)
        if len(inner):
            edge = np.sort(np.concatenate([edge, inner, inner]))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: first[d] .. first[d + 1] are the words of text d
        self.first = np.searchsorted(self.start, offsets, side="left")

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def keep_memory() -> None:
    """Tells glibc to keep up to 128 MB of freed arrays for the next ones. Otherwise each array of some hundred KB goes back to
    the system and comes again page by page, which takes longer than most of the arithmetic."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, Words]]:
    """(row of the first text, words) for runs of rows as in `raw`; a null text has no words."""
    for at, data, offsets in raw(column, size):
        yield at, Words(data, offsets)


def raw(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets of the texts in them) for runs of rows of about `size` bytes; a null text is
    empty. A text longer than that is a slice of its own, never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word's index in words) of every shingle of `size` words within a text, in text order; a text of
    fewer words gives its whole sequence as one shingle, a text without words none."""
    n = len(words.hash)
    lengths = np.diff(words.first)
    out = np.zeros(0, dtype=np.uint64)
    at = np.zeros(0, dtype=np.int64)
    if n >= size:
        acc = words.hash[: n - size + 1] * PLACE[0]
        for j in range(1, size):
            acc = acc + words.hash[j : n - size + 1 + j] * PLACE[j]
        inside = words.doc[: n - size + 1] == words.doc[size - 1 :]
        at = np.flatnonzero(inside)
        out = mix(acc[at])
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        first = words.first[short]
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = lengths[short] > j
            extra[has] += words.hash[first[has] + j] * PLACE[j]
        extra = mix(extra + lengths[short].astype(np.uint64) * PLACE[63])
        at = np.concatenate([at, first])
        order = np.argsort(at, kind="stable")
        at, out = at[order], np.concatenate([out, extra])[order]
    return out, at


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, at = shingles(words, size)
    bounds = np.searchsorted(at, words.first)
    for d in range(words.docs):
        own = np.sort(hashes[bounds[d] : bounds[d + 1]])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
