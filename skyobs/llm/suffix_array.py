"""Suffix arrays by the difference-cover algorithm (modulo 3), on numpy arrays."""

from __future__ import annotations

import numpy as np


def _pair_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Stable order by two non-negative keys."""
    if len(high) and int(high.max()) < 1 << 31 and int(low.max()) < 1 << 32:
        return np.argsort((high.astype(np.int64) << 32) | low, kind="stable")
    return np.lexsort((low, high))


def _names(first: np.ndarray, second: np.ndarray, third: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Names from 1 of triples, in their order, and how many there are. top is above all symbols."""
    if top**3 < 1 << 63:
        key = (first * top + second) * top + third
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = key[1:] != key[:-1]
    else:
        order = np.lexsort((third, second, first))
        fresh = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]) | (third[order][1:] != third[order][:-1])
    names = np.empty(len(first), np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(fresh))) if len(first) else []
    return names, int(names.max(initial=0))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of an array of positive symbols, in order; a suffix's end is below all symbols.

    Triples at positions that are 1 or 2 modulo 3 are sorted and named. Unless all names differ, the string
    of names, positions of 1 before those of 2, is solved in the same way. Suffixes at multiples of 3 are
    sorted by their first symbol and the rank of the rest, and merged: by a symbol or two and a rank, each
    sampled suffix finds how many of the others come before it.
    """
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate((np.asarray(symbols, np.int64), np.zeros(3, np.int64)))
    top = int(s.max()) + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one past the end, if need be, so that no name of 1 runs into those of 2
    twos = np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    names, count = _names(s[sample], s[sample + 1], s[sample + 2], top)
    if count == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[_pair_order(s[zeros], rank[zeros + 1])]
    span = len(sample) + 2
    is_one = sampled % 3 == 1
    i, j = sampled[is_one], sampled[~is_one]
    ahead = np.empty(len(sampled), np.int64)
    ahead[is_one] = np.searchsorted(s[zeros] * span + rank[zeros + 1], s[i] * span + rank[i + 1])
    if top * top * span < 1 << 63:
        ahead[~is_one] = np.searchsorted((s[zeros] * top + s[zeros + 1]) * span + rank[zeros + 2], (s[j] * top + s[j + 1]) * span + rank[j + 2])
    else:  # name the pairs of symbols first
        pairs, back = np.unique(np.concatenate((s[zeros] * top + s[zeros + 1], s[j] * top + s[j + 1])), return_inverse=True)
        ahead[~is_one] = np.searchsorted(back[: len(zeros)] * span + rank[zeros + 2], back[len(zeros) :] * span + rank[j + 2])
    out = np.empty(n, np.int64)
    places = ahead + np.arange(len(sampled))
    out[places] = sampled
    rest = np.ones(n, bool)
    rest[places] = False
    out[rest] = zeros
    return out
