"""Sums of draws with replacement, by how often each value is drawn, on numpy arrays.

How often each of L equal cells is drawn in N draws is a multinomial count. Independent Poisson counts of one mean are one of
T draws, given their total T whatever its law; the N - T draws that are left are made one by one. So counts are Poisson's, of
a mean a few deviations of N below N / L, and work grows with the cells, not with the draws. They are read from a table by
16 random bits; where those don't settle a count, 53 more do, so that the law is Poisson's to a double's precision.
"""

from __future__ import annotations

import numpy as np

#: Cells that are counted at once, and for how many sums: the arrays stay in a core's cache. Cells from which on a table is
#: worth its while.
TILE, TOGETHER, LEAST = 1024, 32, 512
#: Draws that are made one by one at once.
ONES = 1 << 15
#: The mean count up to which tables are used, and deviations of the number of draws that are left for draws one by one.
MOST_MEAN, SPARE = 1024, 3.0
_BITS = 16
_OPEN = np.uint16(0xFFFF)


class Cells:
    """Cells that are drawn alike, with columns of values; ``draws`` says how many draws to expect, and may be wrong."""

    def __init__(self, columns: np.ndarray, draws: float):
        self.size = len(columns)
        self.alike = (columns == columns[:1]).all(0)  # columns of one value need no counts
        self.value = columns[0, self.alike]
        self.columns = np.column_stack([np.ones(self.size), columns[:, ~self.alike]])
        mean = max(0.0, draws - SPARE * draws**0.5) / max(1, self.size)
        self.table = None
        if self.size >= LEAST and 1 / 64 < mean <= MOST_MEAN:
            k = np.arange(int(mean + 40 * mean**0.5 + 60))
            steps = np.zeros(len(k))
            steps[1:] = np.cumsum(np.log(mean) - np.log(k[1:]))
            p = np.exp(steps - steps.max())
            self.below = np.cumsum(p / p.sum())  # P(count <= k)
            self.below[-1] = 2.0  # a number rounded up to 1 still finds a count
            edges = np.arange((1 << _BITS) + 1) / (1 << _BITS)
            low, high = np.searchsorted(self.below, edges[:-1], side="right"), np.searchsorted(self.below, edges[1:], side="left")
            self.table = np.where(low == high, low, _OPEN).astype(np.uint16)

    def sums(self, rng: np.random.Generator, n: np.ndarray) -> np.ndarray:
        """A row of the columns' sums for each number of draws."""
        total = np.zeros((len(n), self.columns.shape[1]))
        if self.table is not None:
            for i in range(0, self.size, TILE):
                own = self.columns[i : i + TILE]
                many = len(n) * len(own)
                bits = rng.bit_generator.random_raw(-(-many // 4)).view(np.uint16)[:many]
                count = self.table.take(bits)
                unsettled = np.flatnonzero(count == _OPEN)
                if len(unsettled):
                    u = (bits[unsettled] + rng.random(len(unsettled))) / (1 << _BITS)
                    count[unsettled] = np.searchsorted(self.below, u, side="right")
                total += count.reshape(len(n), -1).astype(np.float64) @ own
        left = n - total[:, 0].astype(np.int64)
        total[left < 0], left[left < 0] = 0, n[left < 0]  # more than wanted, whichever they were: drawn anew
        few = left <= 8 * self.size
        at = np.repeat(np.arange(len(n)), np.where(few, left, 0))
        for i in range(0, len(at), ONES):
            r, own = at[i : i + ONES], self.columns[rng.integers(0, self.size, min(ONES, len(at) - i))]
            total += np.column_stack([np.bincount(r, c, len(n)) for c in own.T])
        if not few.all():
            total[~few] += rng.multinomial(left[~few], np.full(self.size, 1 / self.size)) @ self.columns
        out = np.empty((len(n), len(self.alike)))
        out[:, self.alike], out[:, ~self.alike] = np.multiply.outer(n, self.value), total[:, 1:]
        return out


class Weighted:
    """Values that are drawn by whole weights: those of one weight are cells alike, the rest a multinomial count."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, draws: float):
        order = np.argsort(weights, kind="stable")
        columns, weights = columns[order], weights[order]
        kinds, first, size = np.unique(weights, return_index=True, return_counts=True)
        whole = float(weights.sum())
        like = (size >= LEAST) & (kinds * (draws / whole) <= MOST_MEAN) if whole else np.zeros(len(kinds), bool)
        self.cells = [Cells(columns[i : i + k], draws * w * k / whole) for w, i, k in zip(kinds[like], first[like], size[like], strict=True)]
        rest = ~np.repeat(like, size)
        self.rest, left = columns[rest], weights[rest].astype(np.float64)
        self.shares = np.append(kinds[like] * size[like], left.sum()) / whole if whole else np.ones(1)
        self.odds = left / left.sum() if left.sum() else left
        if not len(left) and len(self.shares) > 1:  # the last takes what rounding leaves
            self.shares = self.shares[:-1]

    def sums(self, rng: np.random.Generator, n: np.ndarray) -> np.ndarray:
        """A row of the columns' sums for each number of draws."""
        parts = rng.multinomial(n, self.shares).T
        total = np.zeros((len(n), self.rest.shape[1]))
        for cells, k in zip(self.cells, parts, strict=False):
            total += cells.sums(rng, k)
        if len(self.rest):
            total += rng.multinomial(parts[-1], self.odds) @ self.rest
        return total
