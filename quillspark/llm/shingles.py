"""Word shingles of texts as sorted arrays of 64-bit hashes, computed over many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word's hash is a
polynomial in its bytes, taken from running sums over the whole buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import STEP_BYTES, steps, text_steps

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
_powers = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(max(n, STEP_BYTES // 2 + 2), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 1 << 23:
            return out[0], out[1]  # for one very long text; not kept
        _powers = (out[0], out[1])
    return _powers


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    space = np.ones(len(buffer) + 2, np.int8)
    space[1:-1] = _SPACE[buffer]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_LOWER[buffer] * power[: len(buffer)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text; with fewer than k words, the whole sequence as one."""
    none = np.zeros(0, np.uint64)
    for a, b in steps(texts, STEP_BYTES // 2):
        buffer = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        words, starts = word_hashes(buffer)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
        first = np.searchsorted(starts, bounds).tolist()
        n = max(0, len(words) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(k):
            rolled *= _MIX[2]
            rolled += words[i : i + n]
        rolled = mix(rolled)
        for x, y in zip(first, first[1:], strict=False):
            if y - x >= k:
                yield np.unique(rolled[x : y - k + 1])
            elif y > x:
                h = np.array([y - x], np.uint64)
                for w in words[x:y]:
                    h = mix(h * _MIX[2] + w)
                yield h
            else:
                yield none


def column_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """shingle_sets of a column of texts, null as empty, with a step's texts held at once."""
    for _, _, texts in text_steps(column, STEP_BYTES // 2):
        yield from shingle_sets(texts, k)
