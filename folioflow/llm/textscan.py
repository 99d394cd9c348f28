"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. Every word
becomes a 64-bit hash; nothing is allocated per word in Python. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words for brute-force tests, with ``re.findall`` on the lower-cased text.
WORD_PATTERN = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_WORD_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def _powers(base: int, log_n: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log_n
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(n).bit_length()))


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets, bytes) of the lower-cased column, about ``max_bytes`` at a time; one row is never split."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max_bytes, "right")))
        part = pc.utf8_lower(pc.fill_null(column.slice(at, end - at), ""))
        buffers = part.buffers()
        offsets = np.frombuffer(buffers[1],
            np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset : part.offset + len(part) +
            1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        yield at, end, offsets - offsets[0], data[offsets[0] : offsets[-1]]
        at = end


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, for every row the number of words before it)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    is_word = _IS_WORD[data]
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edges = offsets[1:-1]
    inner = edges[edges < n]
    starts[inner] = is_word[inner]
    before = edges[edges > 0] - 1
    ends[before] = is_word[before]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(_WORD_BASE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), np.searchsorted(first, offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all windows of k words that lie in one row, position counted over the slice."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = powers(_WINDOW_BASE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:n], out=sums[1:])
    lengths = np.diff(bounds)
    inside = np.arange(n - k + 1) <= np.repeat(bounds[1:] - k, lengths)[: n - k + 1]
    at = np.flatnonzero(inside)
    return mix((sums[at + k] - sums[at]) * down[at]), at


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by row); a row of fewer than k words, but at least one, is a single shingle."""
    lengths = np.diff(bounds)
    h, at = windows(hashes, bounds, k)
    counts = np.maximum(0, lengths - k + 1)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, row in enumerate(short):
            value = 0
            for x in hashes[bounds[row] : bounds[row + 1]]:
                value = (value * _WINDOW_BASE + int(x) + 1) % 2**64
            extra[i] = value
        ends = np.cumsum(counts)
        h = np.insert(h, ends[short], mix(extra))
        counts[short] = 1
    return h, np.concatenate([[0], np.cumsum(counts)])
