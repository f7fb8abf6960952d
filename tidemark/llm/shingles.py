"""Sets of hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Texts are hashed together until they have so many bytes. Numbers of 64 bits beside each take many times that memory.
TOGETHER = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)
_B = 0x9E3779B97F4A7C15
_kept: list[np.ndarray] = []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64. Only tables for usual runs are kept, not those of a very long text."""
    if not _kept or len(_kept[0]) < n:
        tables = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            row = np.full(max(n, 2 * TOGETHER), np.uint64(base))
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        if n > 2 * TOGETHER:
            return tables
        _kept[:] = tables
    return _kept


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    up, down = _power_tables(len(data) + 1)
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    start = np.flatnonzero(~blank & before)
    end = np.flatnonzero(blank & ~before)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)])])
    hashes = mix((sums[end] - sums[start]) * down[start])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(start, bounds))


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text (UTF-8) its distinct shingle hashes, rising: five words with A-Z lower-cased, fewer words as one, none: none."""
    for part in _together(texts):
        words, counts = _word_hashes(part)
        placed = words * _PLACE[0]
        if len(words) >= SHINGLE:
            full = len(words) - SHINGLE + 1
            rolled = placed[:full].copy()
            for k in range(1, SHINGLE):
                rolled += words[k : k + full] * _PLACE[k]
            rolled = mix(rolled)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                yield np.unique(rolled[at : at + n - SHINGLE + 1])
            elif n:
                yield mix((words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n : n + 1])
            else:
                yield np.zeros(0, np.uint64)
            at += n
