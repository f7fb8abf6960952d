"""Suffix order of many short segments by two-stage sorting, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. The text ends with its only smallest character, 0, also between segments."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.arange(len(step))
    known = np.where(step != 0, at, len(step))  # equal neighbours: as the next unequal pair decides
    following = np.minimum.accumulate(known[::-1])[::-1]
    decided = np.append(step, -1)[np.minimum(following, len(step))]
    return np.append((decided > 0), False)


def window_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts, by their suffixes' first `depth` characters.

    text: uint8, segments each ended by a 0, no other 0s. starts: rising places with `depth` characters of a segment from there.
    Only suffixes smaller than their successors are sorted directly. Every other one follows from its successor's place: the
    buckets of equal first characters are scanned in order, and what stands before a scanned suffix joins its own bucket.
    """
    if not len(starts):
        return starts
    smaller = _types(text)
    base = smaller | (text == 0)  # where chains of larger suffixes end
    at = np.where(base, np.arange(len(text)), len(text) - 1)
    end = np.minimum.accumulate(at[::-1])[::-1]
    change = -np.bincount(end[starts] + 1, minlength=len(text) + 1)
    change[starts] += 1  # starts are different places
    needed = np.cumsum(change[:-1]) > 0

    direct = np.flatnonzero(needed & smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.ascontiguousarray(sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    first = text[direct]  # sorted
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = needed & ~smaller & (text != 0)
    out = []
    for c in range(256):
        low, high = np.searchsorted(first, [c, c + 1]) if c < 255 else (np.searchsorted(first, c), len(first))
        if c == 0:
            scan = [np.flatnonzero(needed & (text == 0))]
        else:
            scan = list(induced[c])
            wave = np.concatenate(scan) if scan else np.zeros(0, np.int64)
            while len(wave):  # larger suffixes that repeat the bucket's own character
                before = wave[wave > 0] - 1
                wave = before[larger[before] & (text[before] == c)]
                if len(wave):
                    scan.append(wave)
            scan.append(direct[low:high])
        scanned = np.concatenate(scan)
        if not len(scanned):
            continue
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            kinds = text[before]
            order = np.argsort(kinds, kind="stable")
            before, kinds = before[order], kinds[order]
            cuts = np.flatnonzero(np.diff(kinds)) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)
    order = np.concatenate(out)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    return order[wanted[order]]


def neighbour_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to depth, of the common prefix of each start in the order with the one before it; 0 for the first."""
    rows = sliding_window_view(text, depth)
    out = np.zeros(len(order), np.int64)
    for begin in range(1, len(order), 100_000):
        here = order[begin : begin + 100_000]
        unlike = rows[here] != rows[order[begin - 1 : begin - 1 + len(here)]]
        out[begin : begin + len(here)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), depth)
    return out
