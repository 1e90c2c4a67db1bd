"""Words of many texts at once: bounds and 64-bit hashes as numpy arrays, no Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from graphloom.llm.common import slices, text_bytes

#: An odd multiplier for chained hashes.
BASE = 0x9E3779B97F4A7C15
#: The first k of eight bytes of a number, least significant first.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Ranges of more bytes than this are digested one by one.
LONG = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """A view [place, 8] of the bytes from every place on; zeros follow the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x1F83D9ABFB41BD6B) -> np.ndarray:
    """A 64-bit hash of every data[start:end], chained over eight bytes at a time: each step is a bijection of the one before."""
    size, view = ends - starts, eights(data)
    h = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed))
    alive, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(alive):
        left = size[alive] - at
        own = view[starts[alive] + at].view("<u8")[:, 0] & FIRST_BYTES[np.minimum(left, 8)]
        h[alive] = mix(h[alive] * np.uint64(BASE) ^ own)
        alive, at = alive[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def two_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, int]) -> np.ndarray:
    """Two ``range_hashes`` [seed, range] at once; every range is read once."""
    size, view = ends - starts, eights(data)
    h = np.stack([mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(s)) for s in seeds])
    order = np.argsort(size, kind="stable")  # the ranges that go on are then a slice
    starts, size, h = starts[order], size[order], h[:, order]
    at, begin = 0, int(np.searchsorted(size, 0, "right"))
    while begin < len(size):
        left = size[begin:] - at
        own = view[starts[begin:] + at].view("<u8")[:, 0] & FIRST_BYTES[np.minimum(left, 8)]
        h[:, begin:] = mix(h[:, begin:] * np.uint64(BASE) ^ own)
        at += 8
        begin = int(np.searchsorted(size, at, "right"))
    out = np.empty_like(h)
    out[:, order] = h
    return out


#: Bytes that separate words (true), by kind of word.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALPHANUMERIC = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NOT_ALPHANUMERIC[_lo : _hi + 1] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of texts ``row``..: text i is data[texts[i]:texts[i+1]] and has words[bounds[i]:bounds[i+1]],
    word j is data[starts[j]:ends[j]]."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.bounds) - 1


def words_of(column: pa.Array, separators: np.ndarray, lower: bool = False, most: int = 1 << 19, clean: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Words]:
    """The words of a text column, about ``most`` bytes of text at a time; ``clean`` changes the bytes first."""
    offsets, raw = text_bytes(column)
    for i, j in slices(offsets, most):
        at = offsets[i : j + 1] - offsets[i]
        data = raw[offsets[i] : offsets[j]]
        data = LOWERED[data] if lower else data
        data = clean(data) if clean else data
        apart = separators[data]
        n = len(data)
        begins, stops = np.empty(n, bool), np.empty(n, bool)
        if n:
            begins[0], stops[-1] = True, True
            begins[1:], stops[:-1] = apart[:-1], apart[1:]
            edges = at[(at > 0) & (at < n)]
            begins[edges], stops[edges - 1] = True, True
            begins &= ~apart
            stops &= ~apart
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Words(i, data, starts, ends, np.searchsorted(starts, at), at)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row, by the first word's place; the order of words counts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out
