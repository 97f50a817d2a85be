"""Words and their hashes, over whole Arrow batches at once.

A word is a run of bytes other than space and tab to carriage return; since
these are ASCII, bytes and code points split alike. Hashes are 64 bits wide:
a multilinear sum over a word's bytes with fixed odd random factors, finished
by a mixing step. Words of over 64 bytes are hashed by xxh64 instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LONG = 64
_FACTORS = _RNG.integers(1, 2**63, _LONG + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
CHUNK_BYTES = 3 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: ``hashes`` and byte ranges of all words in order, ``first[i]:first[i + 1]`` those of text i."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    if not len(texts):
        return
    _, offs = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def split(texts: pa.Array, lower: bool = True) -> Words:
    data, offs = buffers(texts)
    if lower and len(data):
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64), data)
    inside = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(begin, offs)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), begin, end, first, data)
    length = end - begin
    order = np.argsort(-np.minimum(length, _LONG).astype(np.int16), kind="stable")  # longest first, so each step goes over the words that reach so far
    at = begin[order]
    reach = np.searchsorted(-length[order], -np.arange(_LONG), "left")
    partial = np.zeros(len(begin), np.uint64)
    for k in range(int(min(length.max(), _LONG))):
        m = reach[k]
        partial[:m] += _PLUS_ONE.take(data.take(at[:m] + k)) * _FACTORS[k]
    sums = np.empty_like(partial)
    sums[order] = partial
    hashes = mixed(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(length > _LONG):
        hashes[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]].tobytes(), 7)
    return Words(hashes, begin, end, first, data)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of every run of ``n`` words inside a text."""
    if len(w.hashes) < n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    owner = w.owner()
    ok = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    total = np.zeros(len(ok), np.uint64)
    for j in range(n):
        total += w.hashes[ok + j] * _STEPS[j]
    return mixed(total + np.uint64(n)), owner[ok], ok - w.first[owner[ok]]


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Of a sequence of under 64 words, as one."""
    k = len(hashes)
    return mixed(np.array([np.sum(hashes * _STEPS[:k], dtype=np.uint64) + np.uint64(k)], np.uint64))[0]
