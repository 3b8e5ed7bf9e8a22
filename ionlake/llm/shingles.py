"""Word-shingle sets of texts as sorted arrays of 64-bit hashes, built batch-wise with numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, after lower-casing A-Z; a shingle is
``width`` words in a row; a text with fewer words has its whole sequence as its only shingle; a text
without words (or null) has the empty set.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x100000001B3)
_BASE_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (shift-multiply finalizer)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, 64-bit hashes) of the words in a byte array."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    summed = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=summed[1:])
    value = (summed[ends] - summed[starts]) * _powers(_BASE_INV, len(data))[starts]
    return starts, mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None], width: int = 5, slice_bytes: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text, worked through in slices of bytes."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        part.append(raw)
        held += len(raw) + 1
        if held >= slice_bytes:
            out += _sets(part, width)
            part, held = [], 0
    return out + (_sets(part, width) if part else [])


def _sets(part: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])))
    starts, words = word_hashes(data)
    bounds = np.searchsorted(starts, begins)
    counts = np.diff(bounds)
    chained = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        reach = words[k:] if k else words
        chained[: len(reach)] += mix64(reach + np.uint64((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    chained = mix64(chained)
    sets = []
    for first, n in zip(bounds[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(chained[first : first + n - width + 1]))
        elif n:
            short = np.array([n], dtype=np.uint64)
            for i in range(first, first + n):
                short = mix64(short * np.uint64(31) + words[i : i + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
