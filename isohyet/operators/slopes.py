"""The median of the slopes of all pairs of a series, without laying out the pairs."""

from __future__ import annotations

import numpy as np

#: Series of up to this many values have all their pairs laid out at once (some 10 MB).
ALL_PAIRS = 1_000
#: Pairs that are laid out once the median lies among so few: this many, or so many for each value.
LISTED, LISTED_A_VALUE = 100_000, 4


def inversions(rank: np.ndarray, listed: bool = False) -> int | tuple[np.ndarray, np.ndarray]:
    """The number of places i < j with rank[i] > rank[j], or the places themselves; rank is a permutation of 0 to n - 1.

    Ranks are parted by their bits from the highest down, in the order of places: within a part, every 0 counts the 1s before it.
    """
    n, total, found = len(rank), 0, []
    ranks, places, at = rank.copy(), np.arange(n), np.arange(n)
    for bit in reversed(range(max(1, n - 1).bit_length())):
        one = (ranks >> bit) & 1
        start = ranks >> (bit + 1) << (bit + 1)  # ranks below fill the places before the part
        ones = np.cumsum(one) - one
        ones -= ones[start]
        to = np.where(one == 1, start + (1 << bit) + ones, at - ones)
        zeros = np.flatnonzero((one == 0) & (ones > 0))
        total += int(ones[zeros].sum())
        later = places[zeros]
        moved, moved_places = np.empty_like(ranks), np.empty_like(places)
        moved[to], moved_places[to] = ranks, places
        if listed and len(zeros):
            each = ones[zeros]
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            found.append((moved_places[np.repeat(start[zeros] + (1 << bit), each) + nth], np.repeat(later, each)))
        ranks, places = moved, moved_places
    if not listed:
        return total
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


def _order(t: np.ndarray, y: np.ndarray, slope: float) -> np.ndarray:
    """Places by what a line of that slope leaves; of equal remainders the later place comes first."""
    return np.lexsort((-np.arange(len(t)), y - slope * t))


def _rank(order: np.ndarray) -> np.ndarray:
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank


def median_slope(t: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """(median, number) of the slopes of all pairs with different t; of an even number the mean of the middle two.

    Pairs with a slope up to s are those that the remainders y - s t put out of order. Bisection over s, an inversion count each,
    leaves few pairs around the median, which alone are laid out.
    """
    order = np.lexsort((-y, t))
    t, y = t[order] - t.min(initial=0), y[order]
    n = len(t)
    _, held = np.unique(t, return_counts=True)
    twins = int((held * (held - 1) // 2).sum())
    pairs = n * (n - 1) // 2 - twins
    if pairs == 0:
        return None, 0
    middle = ((pairs - 1) // 2, pairs // 2)
    if n <= ALL_PAIRS:
        i, j = np.triu_indices(n, 1)
        apart = t[i] != t[j]
        all_slopes = np.sort((y[j] - y[i])[apart] / (t[j] - t[i])[apart])
        first, second = (float(all_slopes[k]) for k in middle)
    else:
        first = _select(t, y, middle[0], twins)
        second = first if middle[0] == middle[1] else _select(t, y, middle[1], twins)
    return first + (second - first) / 2 + 0.0, pairs


def _select(t: np.ndarray, y: np.ndarray, k: int, twins: int) -> float:
    """The slope number k, from 0, of the pairs with different t; t in order from 0, twins by descending y."""
    n = len(t)
    gap = np.diff(np.unique(t)).min()
    most = float(y.max() - y.min()) / gap or 1.0
    # twins are out of order at any slope
    upto = lambda s: inversions(_rank(_order(t, y, s))) - twins
    low, high, below, within = -2 * most, 2 * most, 0, n * (n - 1) // 2 - twins
    few, error = max(LISTED, LISTED_A_VALUE * n), 16 * np.finfo(float).eps * (np.abs(y).max() / gap + most * (t.max() / gap))
    while within - below > few:
        s = (low + high) / 2
        # the ends stay apart from the slope sought, so that rounding there doesn't matter
        if upto(s + error) <= k:
            low, below = s, upto(s)
        elif upto(s - error) > k:
            high, within = s, upto(s)
        else:
            # many pairs share the slope, to rounding: neighbours in the order of remainders have it
            by_s = _order(t, y, s)
            i, j = by_s[:-1], by_s[1:]
            apart = t[i] != t[j]
            slopes = (y[j] - y[i])[apart] / (t[j] - t[i])[apart]
            return float(slopes[np.argmin(np.abs(slopes - s))])
    # pairs whose order differs at both ends have their slope between
    by_low = _order(t, y, low)
    a, b = inversions(_rank(_order(t, y, high))[by_low], listed=True)
    i, j = by_low[a], by_low[b]
    return float(np.partition((y[j] - y[i]) / (t[j] - t[i]), k - below)[k - below])
