"""Word and shingle hashes of whole Arrow batches in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_WHITE] = 0


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``SLICE_BYTES`` bytes; no null texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of every text); words are runs of anything but ASCII white space."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_WHITE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begins[borders] = solid[borders]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, _U), counts
    at = np.arange(len(data))
    at -= np.maximum.accumulate(np.where(begins, at, 0))
    at[:starts[0]] = 0
    at[~solid] = 0
    powers = np.cumprod(np.full(int(at.max()) + 1, 0x9E3779B97F4A7C15, _U), dtype=_U)
    return mix(np.add.reduceat(_BYTES[data] * powers[at], starts)), counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they are all in its text)."""
    n = len(words)
    ends = np.repeat(np.cumsum(counts), counts)
    whole = ends >= np.arange(n) + k
    out = np.zeros(n, _U)
    for j in range(min(k, n)):
        out *= _U(0xD6E8FEB86659FD93)
        out[:n - j] += words[j:]
    return mix(out), whole
