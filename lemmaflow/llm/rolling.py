"""Byte-level word splitting and rolling hashes in numpy.

A span's hash is a polynomial over random 64-bit values of its bytes, taken from
prefix sums modulo 2**64, so that any number of spans cost a few array operations.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: [^\x20\x09-\x0D] and, after lower-casing A-Z, [^\x00-\x2F\x3A-\x60\x7B-\x7F], as bytes of UTF-8
NOT_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def power(kind: str, n: int) -> np.ndarray:
    """At least the first n powers of the base ("up") or of its inverse ("down")."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """data: uint8. Sums for span_hashes(), one more than there are bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power("up", len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair; equal spans have equal hashes."""
    raw = (sums[ends] - sums[starts]) * power("down", len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` bytes, by start."""
    n = len(sums) - 1 - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[size:] - sums[:n]) * power("down", len(sums))[:n])


def word_bounds(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive entries."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + m]
    return mix(out)
