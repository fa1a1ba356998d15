"""Words and hashes over whole Arrow text buffers in numpy, without a Python loop per word.

A span's hash is a polynomial in the random values of its bytes modulo 2**64, taken from
prefix sums; it is mixed before anything is built on it. There are long texts of two letters that
such hashes don't tell apart, so words of over LONG_WORD bytes have an XXH64 instead.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_lower = np.arange(256)
_lower[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_lower]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=2)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, U(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(1 << max(20, int(size).bit_length()))


class Hasher:
    """Hashes of spans of one buffer."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.forward, self.back = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * self.forward[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.back[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of data (contiguous)."""
    out = Hasher(data)(start, end)
    view = memoryview(data)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(view[start[i] : end[i]], 7)
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes that are inside, documents apart."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    w = inside[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    begin[cuts] = w[cuts]
    finish = w.copy()
    finish[:-1] &= ~w[1:]
    finish[cuts - 1] = w[cuts - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(offsets, start, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each \\n-split line, empty ones included."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    doc = np.concatenate([np.arange(n_docs), owner])
    order = np.lexsort((start, doc))
    end_doc = np.concatenate([owner, np.arange(n_docs)])
    return start[order], end[np.lexsort((end, end_doc))], doc[order]
