"""Exact null distributions of the rank tests, for the samples that are small enough to have them.

Each function takes the counts of one test (one row) and returns a tail of its statistic. Tables never come here: the
statistics and counts are Spark aggregates, and a row of them is what a task gets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Beyond these the rank tests take their normal or asymptotic p-values. The first three are fixed values.
MANN_WHITNEY_LEAST, WILCOXON_MOST, KS_MOST = 8, 50, 10_000
#: Values of U that are enumerated at most: 80 MB. A sample of 8 may stand against some 1.2 million rows.
MANN_WHITNEY_CELLS = 10_000_000


def mann_whitney_upper(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties: subsets of n1 ranks by their sum, as the coefficients of a Gaussian binomial."""
    k, m = sorted((int(n1), int(n2)))
    most = k * m
    half = most // 2
    # coefficients up to the middle only: the rest mirror them, and small ones aren't differences of large ones
    ways = np.zeros(half + 1)
    ways[0] = 1.0
    for i in range(1, k + 1):
        step = m + i
        if step <= half:
            ways[step:] -= ways[: half + 1 - step].copy()
        for at in range(i):
            ways[at::i] = np.cumsum(ways[at::i])
        ways /= (m + i) / i  # stays a share: the binomial's own factors, one at a time
    below = np.concatenate([[0.0], np.cumsum(ways)])
    least = int(np.ceil(u - 1e-9))
    if least <= 0:
        return 1.0
    if most - least <= half:
        return float(below[max(0, most - least + 1)])
    return float(1.0 - below[least])


def wilcoxon_upper(w: float, n: int) -> float:
    """P(W+ >= w) of n signed ranks without ties or zeros."""
    ways = np.ones(1)
    for r in range(1, int(n) + 1):
        ways = (np.pad(ways, (0, r)) + np.pad(ways, (r, 0))) / 2
    least = int(np.ceil(w - 1e-9))
    return float(ways[max(0, least) :].sum()) if least > 0 else 1.0


def smirnov_upper(d: float, n1: int, n2: int, two_sided: bool) -> float:
    """P(D >= d), or P(D+ >= d): the share of lattice paths that leave the band, along the diagonals."""
    n1, n2 = int(n1), int(n2)
    reach = round(d * n1 * n2)
    if reach <= 0:
        return 1.0
    left = np.zeros(1)  # by i on the diagonal i + j = s: the share of paths to (i, j) that have left
    first = 0
    for s in range(1, n1 + n2 + 1):
        low, high = max(0, s - n2), min(n1, s)
        i = np.arange(low, high + 1)
        padded = np.zeros(high - low + 3)
        padded[first - low + 1 : first - low + 1 + len(left)] = left  # position 1 holds i = low
        now = (i * padded[: len(i)] + (s - i) * padded[1 : len(i) + 1]) / s
        gap = i * n2 - (s - i) * n1
        now[(np.abs(gap) if two_sided else gap) >= reach] = 1.0
        left, first = now, low
    return float(left[0])


def kolmogorov_upper(d: float, n: float) -> float:
    """P(D >= d) of the two-sided one-sample statistic of n values, n being 100 or more, by an expansion in powers of 1 / sqrt(n).

    Far in the tail, where its complement has no digits left, it is twice the one-sided tail.
    """
    n, d = int(n), float(d)
    z = math.sqrt(n) * d
    if z <= 0.2:
        return 1.0
    if z > 2.5:
        return min(1.0, 2 * math.exp(-((6 * n * d + 1) ** 2) / (18 * n)))
    z2 = z * z
    half, whole = (np.arange(-12, 12) + 0.5) ** 2 * np.pi**2, np.arange(-12, 13) ** 2 * np.pi**2
    eh, ew = np.exp(-half / (2 * z2)), np.exp(-whole / (2 * z2))
    root = math.sqrt(np.pi / 2)
    k0 = root * eh.sum() / z
    k1 = root * ((half - z2) * eh).sum() / (6 * z2**2)
    k2 = root * ((6 * z2**3 + 2 * z2**2 + half * (2 * z2**2 - 5 * z2) + half**2 * (1 - 2 * z2)) * eh).sum() / (72 * z * z2**3) - root * (whole * ew).sum() / (36 * z * z2)
    k3 = root * ((half**3 * (5 - 30 * z2) + half**2 * (212 * z2**2 - 60 * z2) + half * (135 * z2**2 - 96 * z2**3) - (30 * z2**3 + 90 * z2**4)) * eh).sum() / (6480 * z2**5)
    k3 += root * ((3 * whole * z2 - whole**2) * ew).sum() / (2160 * z2**3)
    return float(min(1.0, max(0.0, 1 - (k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5))))


def column(tail: Callable[..., float], *arguments: Column) -> Column:
    """A tail of columns; null where an argument is."""

    def rows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([None if any(pd.isna(x) for x in row) else tail(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return F.pandas_udf(rows, DoubleType())(*arguments)
