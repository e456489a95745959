"""Exact quantiles of tables of any size, and ranks of points inside a task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ranked(v: DataFrame, ranks: tuple[int, int], most: int) -> list[float]:
    """The values of two successive ranks (from 0) of the column ``v``."""
    k, last = ranks
    part, below = v, 0
    m = part.count()
    while m > most:
        r, r2 = k - below, last - below
        low, high = part.approxQuantile("v", [max(0.0, r / m - 0.005), min(1.0, (r2 + 1) / m + 0.005)], 0.001)
        c = part.agg(F.count_if(F.col("v") < low).alias("less"), F.count_if(F.col("v") <= high).alias("up"), F.count_if(F.col("v") == low).alias("low"), F.count_if(F.col("v") == high).alias("high")).first()
        if not (c["less"] <= r and r2 < c["up"]):
            raise RuntimeError("quantile bounds missed their rank")
        if r2 < c["less"] + c["low"]:
            return [low, low]
        if r >= c["up"] - c["high"]:
            return [high, high]
        # Values that repeat at either end and don't hold the ranks are left out, so every round is smaller.
        start = r >= c["less"] + c["low"]
        end = r2 < c["up"] - c["high"]
        part = part.where((F.col("v") > low if start else F.col("v") >= low) & (F.col("v") < high if end else F.col("v") <= high))
        below += c["less"] + (c["low"] if start else 0)
        now = c["up"] - c["less"] - (c["low"] if start else 0) - (c["high"] if end else 0)
        if now == m:  # the ranks lie on both ends' repeats
            return [low, high]
        m = now
    values = sorted(row["v"] for row in part.collect())
    return [values[k - below], values[last - below]]


def quantiles(table: DataFrame, column, shares: list[float], most: int = 100_000) -> list[float | None]:
    """Exact quantiles, linear between ranks, of a column's known values; null for an empty table.

    Rounds of approximate quantiles narrow each down to the values around its rank, until at most ``most`` are left to
    be sorted, so no task and no driver holds the column.
    """
    c = F.col(column) if isinstance(column, str) else column
    v = table.select(c.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, out = v.count(), []
    for share in shares:
        if not n:
            out.append(None)
            continue
        h = (n - 1) * share
        k = min(math.floor(h), n - 1)
        a, b = _ranked(v, (k, min(k + 1, n - 1)), most)
        out.append(a + (b - a) * (h - k))
    return out


class Dominance:
    """Number and sums of values of the points among the first so many in x and the first so many in y.

    Each bit of the ranks in x, from the highest on, parts the points in two, the order in y stays; counts and sums of the lower
    half so far let a question go down bit by bit.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, values: np.ndarray):
        self.n, self.levels = len(x), []
        rank = np.empty(self.n, np.int64)
        rank[np.argsort(x, kind="stable")] = np.arange(self.n)
        order = np.argsort(y, kind="stable")
        ordered = lambda order: np.column_stack((np.ones(self.n), values[order]))
        self.along = [np.r_[np.zeros((1, values.shape[1] + 1)), ordered(o).cumsum(0)] for o in (np.argsort(x, kind="stable"), order)]
        rank, values = rank[order], ordered(order)
        for bit in range(self.n.bit_length() - 1, -1, -1):
            sums = np.zeros((self.n + 1, values.shape[1]))
            np.cumsum(values * (rank >> bit & 1 == 0)[:, None], 0, out=sums[1:])
            self.levels.append((bit, sums))
            order = np.argsort(rank >> bit, kind="stable")
            rank, values = rank[order], values[order]

    def __call__(self, in_x: np.ndarray, in_y: np.ndarray) -> np.ndarray:
        """Counts and sums (last axis) for numbers of points in x and in y, of any shapes that go together."""
        in_x, in_y = np.broadcast_arrays(in_x, in_y)
        shape, in_x, in_y = in_x.shape, in_x.ravel(), in_y.ravel()
        out = np.zeros((len(in_x), self.levels[0][1].shape[1]))
        all_x, all_y = in_x == self.n, in_y == self.n
        out[all_y], out[all_x] = self.along[0][in_x[all_y]], self.along[1][in_y[all_x]]
        some = np.flatnonzero((in_x > 0) & (in_y > 0) & ~all_x & ~all_y)
        x, left = in_x[some], in_y[some]
        found, start = np.zeros((len(some), out.shape[1])), np.zeros(len(some), np.int64)
        for bit, sums in self.levels:
            low = sums[start + left] - sums[start]
            high = x >> bit & 1 == 1
            found += low * high[:, None]
            here = low[:, 0].astype(np.int64)
            left = np.where(high, left - here, here)
            start = np.minimum(start + (high.astype(np.int64) << bit), self.n)
        out[some] = found
        return out.reshape(*shape, -1)


def below(places: np.ndarray, others: np.ndarray, cell: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first bin that the others fall into, and how many of them lie below each next bin's end, from 0 on.

    Bins are lags in cells, rounded half to even and held to ``most`` either way.
    """
    ends, count = np.unique(others, return_counts=True)
    count = np.r_[0, count.cumsum()]
    bin_of = lambda other: np.clip(np.rint((other - places) / cell), -most, most)
    first, last = bin_of(ends[0]), bin_of(ends[-1])
    ranks = [np.zeros(len(places), np.int64)]
    for j in range(int((last - first).max()) + 1):
        k = first + j
        t = np.searchsorted(ends, places + (k + 0.5) * cell)
        while True:  # rounding may put a bin's end a step off
            up = (t < len(ends)) & (bin_of(ends[np.minimum(t, len(ends) - 1)]) <= k)
            down = (t > 0) & (bin_of(ends[np.maximum(t - 1, 0)]) > k)
            if not (up.any() or down.any()):
                break
            t = t + up - down
        ranks.append(count[np.where(k >= most, len(ends), t)])
    return first.astype(np.int64), np.stack(ranks, 1)
