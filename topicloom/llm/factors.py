"""Dictionaries of basic factors: for each power of two a number for the factor of that length at every place, equal where the factors are."""

from __future__ import annotations

import numpy as np


def common_extension(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from places a and b on (back: before them). names[k]: numbers of the factors of length 2 ** k, negative where there is none; no factors of twice the last length may agree at a and b."""
    a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, name = 1 << k, names[k]
        x, y = (a - step, b - step) if back else (a, b)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(name))
        at, to = np.where(inside, x, 0), np.where(inside, y, 0)
        equal = inside & (name[at] == name[to]) & (name[at] >= 0) if len(name) else inside
        move = np.where(equal, step, 0)
        found += move
        a, b = (a - move, b - move) if back else (a + move, b + move)
    return found


def repeated_factors(symbols: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Numbers of the factors that occur more than once, -1 for all others, up to the longest that does. symbols: equal only within one sequence; rest: symbols from a place to its sequence's end, itself included.

    A factor occurs again only where both its halves do, so each level numbers what is left of the one before.
    """
    names, at, code, step = [], np.arange(len(symbols)), symbols, 1
    while True:
        _, number, count = np.unique(code, return_inverse=True, return_counts=True)
        again = count[number] > 1
        level = np.full(len(symbols), -1, np.int32)
        level[at[again]] = number[again]
        names.append(level)
        at = at[again]
        at = at[rest[at] >= 2 * step]
        at = at[level[at + step] >= 0]
        if not len(at):
            return names
        code = level[at].astype(np.int64) << 32 | level[at + step]
        step *= 2
