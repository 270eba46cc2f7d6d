"""Vectorised hashes of words and of runs of words over batches of texts."""

from __future__ import annotations

import numpy as np

_BYTES, _WORDS = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, at least n of each."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(key, -1, 1 << 64)
        made = []
        for b in (key, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[key] = tuple(made)
    up, down = _powers[key]
    return up[:n], down[:n]


def _runs(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the run stands."""
    up, down = _table(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that aren't ASCII white space), and where each text's words begin; one more
    entry closes the last text."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buffer = LOWER[buffer]
    blank = BLANKS[buffer]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
    starts, ends = edge[::2], edge[1::2]
    hashes = _runs(buffer.astype(np.uint64) + np.uint64(1), _BYTES, starts, ends)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.concatenate(([0], np.searchsorted(starts, text_ends)))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; the last length - 1 have none."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return _runs(hashes, _WORDS, at, at + length)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values from each on."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        reach += step
    return values
