"""Words of many texts at once, as numbers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. The functions work on
one Arrow batch of texts as a single byte array, so that no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    step = _BASE
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have:have + more] = out[:more] * step
            have += more
            step = step * step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (one entry more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words lie before each text (one entry more than texts)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    table = BYTE[_LOWER] if lower else BYTE
    with np.errstate(over="ignore"):
        value = table[raw[at]] * powers(int(lengths.max()))[within]
        h = np.add.reduceat(value, first)
        return mix(h + lengths.astype(np.uint64) * _BASE)


def grams(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, and how many runs lie before each text.

    A text with fewer words, but at least one, gives one run of all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    before = np.concatenate([[0], np.cumsum(runs)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    begin = np.arange(before[-1]) - np.repeat(before[:-1], runs) + np.repeat(first[:-1], runs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    p = powers(size + 1)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        h = np.zeros(len(begin), np.uint64)
        for k in range(size):
            h += padded[begin + k] * p[k + 1]
        for t in short:
            own = words[first[t]:first[t + 1]]
            h[before[t]] = (own * p[1:len(own) + 1]).sum(dtype=np.uint64) + np.uint64(len(own)) * BYTE[7]
        return mix(h), before
