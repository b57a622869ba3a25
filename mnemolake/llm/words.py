"""Vectorised words of a text: ASCII letters (lower-cased), ASCII digits and every non-ASCII character.

A text becomes three arrays: where each word starts and ends in its UTF-8 bytes, and a 64-bit hash of the
lower-cased word. No Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=np.int8)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = 1
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    global _tables
    if _tables is None or len(_tables[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _tables = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _BACK))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(_WORD[raw], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each [start, end) of raw; works through a long text in pieces of bounded size."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, side="right")))
        begin = int(starts[first])
        s, e = starts[first:last] - begin, ends[first:last] - begin
        up, down = _powers(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((LOWER[raw[begin : begin + int(e[-1])]].astype(np.uint64) + np.uint64(1)) * up[: int(e[-1])], out=total[1:])
        out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def word_hashes(text: str) -> np.ndarray:
    raw = raw_bytes(text)
    return hashes(raw, *spans(raw))


def word_list(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    low = LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; one for all words where there are fewer than k, none where there are none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : n - k + 1 + i]
    return mix(out)
