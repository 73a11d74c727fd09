"""Maximal runs of item sequences by string synchronising sets (numpy, inside tasks).

A run is a stretch that repeats with period p, is at least twice as long and
cannot be extended. Periods below ``SMALL`` are found by comparing the sequence
with itself shifted. Larger ones come from scales t = 4, 8, 16, ...; scale t
finds the periods from 3t to below 6t:

* The synchronising set of a scale: position i belongs to it if the smallest
  hash of the windows of t items that start at i to i + t is that of the first
  or the last of them. Windows inside a highly periodic region (a run of period
  up to t / 3, known from smaller scales) take no part. Whether i belongs is
  decided by the 2t items from i alone, and any 3t - 1 items that are not highly
  periodic as a whole have a member among their first t positions.
* A run of period p >= 3t therefore has a member i in its first p items, and
  i + p is a member with the same 2t items. Members with equal contexts lie more
  than t / 3 apart, so each meets a bounded number of others at a distance from
  3t to 6t; each such pair proposes a period, which is extended both ways.
* The exception is a run whose first p items are highly periodic with some r.
  The regions of its first two repeats then touch or overlap and have the same
  root, so pairs of touching regions propose every period that fits their phase.

Hashes only propose: equal hashes of different items could add a proposal but
lose none, extensions are checked item by item.
"""

from __future__ import annotations

import numpy as np

from sieveline.llm.superminhash import mix

#: Periods below this are found by shifting; the first scale begins here.
SMALL = 12
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MAX = np.iinfo(np.uint64).max


class Sequence:
    """Items (int64 ids) with rolling hashes of all their stretches."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.items = items
        up, self.down = (np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(n, b, dtype=_U))])
                         for b in (_BASE, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(items.astype(_U)) * up[:n])])

    def hashes(self, start, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all_hashes(self, n: int, length: int) -> np.ndarray:
        """Of every stretch of ``length`` in the first n items."""
        k = n - length + 1
        return (self.sums[length:n + 1] - self.sums[:k]) * self.down[:k]

    def extended(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The longest stretches (start, end, period) with period p around the pairs i, i + p."""
        n = len(self.items)
        right, left = np.zeros_like(i), np.zeros_like(i)
        for step in (1 << k for k in range(n.bit_length(), -1, -1)):
            j = i + right
            ok = np.flatnonzero(j + p + step <= n)
            right[ok] += step * (self.hashes(j[ok], step) == self.hashes(j[ok] + p[ok], step))
            j = i - left - step
            ok = np.flatnonzero(j >= 0)
            left[ok] += step * (self.hashes(j[ok], step) == self.hashes(j[ok] + p[ok], step))
        return np.stack([i - left, i + p + right, p], axis=1)

    def checked(self, runs: np.ndarray) -> np.ndarray:
        """The runs, those with items that only hash alike cut and extended again one by one."""
        start, end, p = runs.T
        at, of = ragged(start, end - p - start)
        wrong = np.unique(of[self.items[at] != self.items[at + p[of]]])
        for k in wrong:
            alike = self.items[:-p[k]] == self.items[p[k]:]
            stops = np.flatnonzero(~alike)
            mid = (start[k] + end[k] - p[k]) // 2
            after = stops[stops >= mid]
            before = stops[stops < mid]
            runs[k, 0] = before[-1] + 1 if len(before) else 0
            runs[k, 1] = (after[0] if len(after) else len(alike)) + p[k]
        return runs


def ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start + 1, ... of all stretches, and the stretch each belongs to."""
    of = np.repeat(np.arange(len(start)), length)
    first = np.cumsum(length) - length
    return np.arange(len(of)) - first[of] + start[of], of


def window_min(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of a[i:i + size] for every i."""
    w = 1
    while 2 * w <= size:
        a = np.minimum(a[:-w], a[w:])
        w *= 2
    return np.minimum(a[:len(a) - (size - w)], a[size - w:]) if size > w else a


def _primitive(runs: np.ndarray) -> np.ndarray:
    """One row of each stretch, with its smallest period."""
    runs = runs[np.lexsort(runs.T[::-1])]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _by_shifts(items: np.ndarray, least: int) -> np.ndarray:
    """Runs of periods below SMALL; from three periods on also shorter than ``least``: larger scales need them."""
    out = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, min(SMALL, len(items))):
        at = np.flatnonzero(items[q:] == items[:-q])
        cuts = np.flatnonzero(np.diff(at) != 1)
        start = at[np.concatenate([[0], cuts + 1])] if len(at) else at
        end = at[np.concatenate([cuts, [-1]])] + 1 + q if len(at) else at
        long = end - start >= min(max(least, 2 * q), max(4, 3 * q))
        out.append(np.stack([start[long], end[long], np.full(long.sum(), q)], axis=1))
    return _primitive(np.concatenate(out))


def members(seq: Sequence, n: int, t: int, runs: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set of scale t in the first n items."""
    k = n - t + 1
    ident = np.minimum(mix(seq.all_hashes(n, t)), _MAX - _U(1))
    start, end, period = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 1] <= n)].T
    if len(start):
        edge = np.bincount(start, minlength=k + 1) - np.bincount(end - t + 1, minlength=k + 1)
        ident[np.cumsum(edge)[:k] > 0] = _MAX
    low = window_min(ident, t + 1)
    return np.flatnonzero(((ident[:k - t] == low) | (ident[t:] == low)) & (low != _MAX))


def _from_contexts(seq: Sequence, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members with equal contexts at a distance of 3t to below 6t, as (position, distance)."""
    context = seq.hashes(at, 2 * t)
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    here, found = np.arange(len(at)), []
    lag = 0
    while len(here):
        lag += 1
        here = here[here + lag < len(at)]
        here = here[(context[here] == context[here + lag]) & (at[here + lag] - at[here] < 6 * t)]
        found.append(here[at[here + lag] - at[here] >= 3 * t] if len(here) else here)
        found[-1] = np.stack([at[found[-1]], at[found[-1] + lag] - at[found[-1]]])
    return tuple(np.concatenate([np.zeros((2, 0), dtype=np.int64), *found], axis=1))


def _from_regions(seq: Sequence, runs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """What touching regions of one small period propose, as (position, distance)."""
    near = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t)]
    near = near[np.lexsort((near[:, 0], near[:, 2]))]
    touch = np.flatnonzero((near[:-1, 2] == near[1:, 2]) & (near[1:, 0] <= near[:-1, 1]))
    if not len(touch):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # The phase of a region: where the smallest of its root's rotations starts.
    start, _, r = near.T
    at, of = ragged(start, r)
    h = seq.hashes(at, r[of])
    least = np.minimum.reduceat(h, np.cumsum(r) - r)
    phase = np.full(len(near), np.iinfo(np.int64).max)
    np.minimum.at(phase, of, np.where(h == least[of], at, np.iinfo(np.int64).max))
    touch = touch[least[touch] == least[touch + 1]]
    a, b = near[touch], near[touch + 1]
    r = a[:, 2]
    first = 3 * t + (phase[touch + 1] - phase[touch] - 3 * t) % r
    last = np.minimum(np.minimum(6 * t - 1, a[:, 1] - a[:, 0]), b[:, 1] - b[:, 0])
    step, of = ragged(np.zeros_like(first), np.maximum((last - first) // r + 1, 0))
    p = first[of] + step * r[of]
    return a[of, 1] - p, p


def maximal_runs(items: np.ndarray, reach, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` items, by start and period.

    ``reach(length)`` is the number of leading items that hold every sequence of at least that length; sequences
    are kept apart by items that occur once.
    """
    runs = _by_shifts(items, least)
    seq = Sequence(items)
    t = SMALL // 3
    while (n := reach(6 * t)) >= 6 * t:
        i, p = (np.concatenate(x) for x in zip(_from_contexts(seq, members(seq, n, t, runs), t),
                                               _from_regions(seq, runs, t), strict=True))
        if len(i):
            new = np.unique(seq.extended(i, p), axis=0)
            new = seq.checked(new[new[:, 1] - new[:, 0] >= 2 * new[:, 2]])
            runs = _primitive(np.concatenate([runs, new[new[:, 1] - new[:, 0] >= 2 * new[:, 2]]]))
        t *= 2
    length = runs[:, 1] - runs[:, 0]
    runs = runs[(length >= least) & (length >= 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
