"""Counting pairs of a series by the sign of their rise, in n log n."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def pair_sign_sum(x: np.ndarray) -> int:
    """Sum over i < j of sign(x[j] - x[i]).

    Ranks are split bit by bit from the top: among values equal in all higher bits, an earlier 1
    before a later 0 is a falling pair, and the rest of such mixed pairs rise.
    """
    r = np.unique(x, return_inverse=True)[1].astype(np.int64)
    if len(r) < 2:
        return 0
    total = 0
    for b in range(int(r.max()).bit_length() - 1, -1, -1):
        prefix = r >> (b + 1)
        order = np.argsort(prefix, kind="stable")
        p, bit = prefix[order], (r[order] >> b) & 1
        start = np.concatenate([[True], p[1:] != p[:-1]])
        ones = np.cumsum(bit)
        first = np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))
        ones_before = ones - bit - np.where(first > 0, ones[first - 1], 0)
        zeros_before = np.arange(len(p)) - first - ones_before
        total += int(zeros_before[bit == 1].sum() - ones_before[bit == 0].sum())
    return total


def falling_pairs(ranks: np.ndarray) -> int:
    """Pairs of distinct numbers of which the earlier is the larger."""
    return (len(ranks) * (len(ranks) - 1) // 2 - pair_sign_sum(ranks)) // 2


def tied_pairs(ranks: np.ndarray) -> int:
    t = np.unique(ranks, return_counts=True)[1].astype(np.int64)
    return int((t * (t - 1) // 2).sum())


def slope_order(x: np.ndarray, at: np.ndarray, p: int, q: int) -> np.ndarray:
    """Dense ranks of q * x - p * at, exact for |x|, |p| < 2**62 and at, q < 2**31: the products are kept in two parts."""
    mask = np.int64(2**32 - 1)
    low = q * (x & mask) - at * np.int64(p & (2**32 - 1))
    high = q * (x >> 32) - at * np.int64(p >> 32) + (low >> 32)
    low &= mask
    order = np.lexsort((low, high))
    new = np.zeros(len(x), dtype=np.int64)
    new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    ranks = np.empty(len(x), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def crossing_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs i < j with ranks[i] > ranks[j], for distinct ranks 0 .. n - 1; n log n and the pairs themselves."""
    n, half, at = len(ranks), 1, np.arange(len(ranks))
    earlier, later = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while half < n:
        run = at // half
        order = np.lexsort((ranks, run))
        keys = run[order] * n + ranks[order]
        right = np.flatnonzero(run % 2 == 1)
        first = np.searchsorted(keys, (run[right] - 1) * n + ranks[right])
        count = run[right] * half - first
        start = np.repeat(first - np.cumsum(count) + count, count)
        earlier.append(order[start + np.arange(count.sum())])
        later.append(np.repeat(right, count))
        half *= 2
    return np.concatenate(earlier), np.concatenate(later)


def _inside(x: np.ndarray, at: np.ndarray, lo: tuple[int, int], hi: tuple[int, int]) -> np.ndarray:
    """Slopes of the pairs strictly between two slopes p / q: the pairs that the orders along both put differently."""
    n = len(x)
    place = np.empty(n, np.int64)
    place[np.lexsort((at, slope_order(x, at, *hi)))] = np.arange(n)
    by_lo = np.lexsort((-at, slope_order(x, at, *lo)))
    i, j = (by_lo[k] for k in crossing_pairs(place[by_lo]))
    return (x[j] - x[i]) / (at[j] - at[i])


def median_slope(x: np.ndarray, at: np.ndarray, listed: int = 2**22, tries: int = 24) -> float:
    """Mean of the middle slope or slopes of all pairs of one block, each the slope of a pair.

    At most `listed` pairs are listed at once. Of more, counts of probe slopes over all pairs bracket the middle ranks until so few are left; probes come from a
    sample of pairs, so slopes that many pairs share are met as well.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    wanted = sorted({(pairs + 1) // 2, pairs // 2 + 1})
    if pairs <= listed:
        i, j = np.triu_indices(n, 1)
        return float(np.mean(np.partition((x[j] - x[i]) / (at[j] - at[i]), [k - 1 for k in wanted])[[k - 1 for k in wanted]]))
    edge = int(x.max() - x.min()) + 1
    rng, found = np.random.default_rng(n), []
    for k in wanted:
        lo, hi, below, upto, hit = (-edge, 1), (edge, 1), 0, pairs, None
        i, j = rng.integers(0, n, (2, 2**16))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        p, q = x[j] - x[i], at[j] - at[i]
        order = np.argsort(p / q, kind="stable")
        p, q = p[order], q[order]
        for _ in range(tries):
            if upto - below <= listed or hit is not None:
                break
            own = (p / q > lo[0] / lo[1]) & (p / q < hi[0] / hi[1])
            p, q = p[own], q[own]
            if len(p):
                middle, wide = (k - below) / (upto - below) * len(p), np.sqrt(len(p))
                near = np.unique(np.clip(np.rint([middle - wide, middle, middle + wide]).astype(int), 0, len(p) - 1))
                probes = [(int(p[a]), int(q[a])) for a in near]
            else:
                half = (lo[0] / lo[1] + hi[0] / hi[1]) / 2
                parts = 2**30 if abs(half) < 2.0**31 else 1
                probes = [(round(half * parts), parts)]
            for probe in probes:
                ranks = slope_order(x, at, *probe)
                equal = tied_pairs(ranks)
                less = (pairs - equal - pair_sign_sum(ranks)) // 2
                if less < k <= less + equal:
                    hit = probe[0] / probe[1]
                elif less + equal < k and less + equal > below:
                    lo, below = probe, less + equal
                elif less >= k and less < upto:
                    hi, upto = probe, less
        if hit is None:
            slopes = _inside(x, at, lo, hi)
            hit = np.partition(slopes, k - below - 1)[k - below - 1]
        found.append(hit)
    return float(np.mean(found))


def trend_z(s: int, n: int, ties: int) -> float:
    """The test's score; `ties` is the sum of t(t-1)(2t+5) over groups of equal values."""
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    if s == 0 or var <= 0:
        return 0.0
    return (s - np.sign(s)) / var**0.5


def critical(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)
