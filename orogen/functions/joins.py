"""Joins by distance."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed


#: Rows of a task that sorts them several times over.
_SHARE = 100_000

#: Points of a small square of ``block_pairs``: arrays of its pairs stay in a core's cache.
_SQUARE = 160


#: Points that each of two blocks must hold to be worth sorting.
_WHOLE = 2_000


def near_join(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", keep: bool = False) -> DataFrame:
    """Pairs (columns ``l_*`` and ``r_*``, distance ``h``) at most ``radius`` apart in the plane.

    Both sides fall into square bins of side ``radius``; the right side is repeated in its bin and the
    eight around it, so the join is an equi-join on bins, and never a broadcast, whose size estimates don't tell the repeats. Tasks grow in number with
    the points; only where a bin is crowded it is left to Spark, which splits what is large. With ``keep`` the left side's bins (``_bx``, ``_by``) stay,
    so what is joined by them next needs no shuffle of the pairs.
    """
    bin_of = lambda c: F.floor(F.col(c) / radius)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], bin_of(x).alias("_bx"), bin_of(y).alias("_by"))
    around = F.explode(F.array(*[F.struct((bin_of(x) + i).alias("_bx"), (bin_of(y) + j).alias("_by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], around.alias("_b")).select("*", "_b._bx", "_b._by").drop("_b")
    bins = ["_bx", "_by"]
    most = lambda t: t.groupBy(*bins).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    own = most(a.select(*bins))
    other = own if left is right else most(right.select(bin_of(x).alias("_bx"), bin_of(y).alias("_by")))
    if max(own["most"], other["most"]) <= _SHARE // 100:
        n = max(left.sparkSession.sparkContext.defaultParallelism, -(-(own["n"] + 9 * other["n"]) // _SHARE))
        a, b = a.repartition(n, *bins), b.repartition(n, *bins)
    dx, dy = F.col(f"r_{x}") - F.col(f"l_{x}"), F.col(f"r_{y}") - F.col(f"l_{y}")
    return a.join(b.hint("merge"), bins).withColumn("h", F.sqrt(dx * dx + dy * dy)).where(F.col("h") <= radius).drop(*([] if keep else bins))


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of ``points`` (id, x, y, ...) at most ``radius`` apart, each once."""
    return near_join(points, points, radius).where("l_id < r_id")


def block_pairs(points: DataFrame, reach: float, columns: list[str], kernel: Callable[..., pd.DataFrame], schema: str, block: int | None = None, summed: Callable[[np.ndarray], pd.DataFrame] | None = None, round_reach: bool = True, whole: Callable[..., np.ndarray | None] | None = None) -> DataFrame:
    """What ``kernel`` makes of all pairs of points at most about ``reach`` apart, each pair once, added up where the pairs arise.

    Points fall into square blocks of some ``block`` points, an eighth of the reach wide at least; blocks where points crowd are dealt into
    parts. Each two blocks or parts in reach of one another are a task's work, so pairs are never rows. ``kernel`` gets the columns of some
    left points, those of some right ones, all near one another, and a mask of the pairs that count, or None for all: it is called for
    small squares of both that may lie in reach, so it can tell from their bounds what all their pairs have in common. Every point is sent once for
    each block in its reach that holds points, so blocks grow with the number of points, from 1,500 to 250,000 (100,000 with ``whole``). With ``summed`` the kernel
    returns arrays, and ``summed`` makes a frame of their sum. Where two blocks hold ``_WHOLE`` points each, ``whole`` (left points, right points, whether they are the same)
    may return such an array for all their pairs at once, those in reach or not; where it returns None, ``kernel`` is called. Without ``round_reach`` pairs count that are at most so far apart along each axis.
    """
    b = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not b["n"]:
        return points.sparkSession.createDataFrame([], schema)
    block = block or (min(max(b["n"] // 16, 1500), 100_000) if whole else min(max(b["n"] // 64, 1500), 250_000))
    area = max(b["x1"] - b["x0"], reach / 8) * max(b["y1"] - b["y0"], reach / 8)
    side = max(math.sqrt(area * block / b["n"]), reach / 8)
    k = math.ceil(reach / side)
    # Half of the offsets: the others are the same two blocks the other way round.
    gap = lambda i, j: math.hypot(max(0, abs(i) - 1), max(0, abs(j) - 1)) * side
    offsets = [(i, j) for i in range(k + 1) for j in range(-k, k + 1) if (i > 0 or j >= 0) and (not round_reach or gap(i, j) <= reach * (1 + 1e-9))]
    last = [math.floor((b[f"{c}1"] - b[f"{c}0"]) / side) for c in "xy"]
    laid = points.select(*columns, F.floor((F.col("x") - b["x0"]) / side).alias("bx"), F.floor((F.col("y") - b["y0"]) / side).alias("by"))
    # A block that holds far more points than others is dealt into parts, so that each two parts are a task's work.
    crowded = laid.groupBy("bx", "by").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block)
    crowded = crowded.select("bx", "by", F.ceil(F.col("n") / block).cast("int").alias("parts")).toDF("cx", "cy", "parts")
    heavy = crowded.count() > 0
    crowded = checkpointed(crowded) if heavy else crowded

    def parts_of(t: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
        """``name``: the number of parts of a block."""
        if not heavy:
            return t.withColumn(name, F.lit(1))
        return t.join(crowded.withColumnRenamed("parts", name), (x == F.col("cx")) & (y == F.col("cy")), "left").drop("cx", "cy").withColumn(name, F.coalesce(name, F.lit(1)))

    own = parts_of(laid, F.col("bx"), F.col("by"), "parts").withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int")) if heavy else laid.withColumn("part", F.lit(0))
    # Points are few bytes but are sent many times, so they are dealt first.
    own = own.repartition(points.sparkSession.sparkContext.defaultParallelism, *columns)
    steps = F.array(*[F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy")) for i, j in offsets])
    inside = lambda sign: (F.col("bx") + sign * F.col("k.ox")).between(0, last[0]) & (F.col("by") + sign * F.col("k.oy")).between(0, last[1])
    first = lambda c, sign: (F.col(f"b{c}") - F.col(f"k.o{c}") if sign else F.col(f"b{c}")).alias(f"b{c}")
    spread = lambda sign: own.select("*", F.explode(steps).alias("k")).where(inside(-1 if sign else 1)).select(*columns, "part", first("x", sign), first("y", sign), "k.ox", "k.oy")
    left = parts_of(spread(0), F.col("bx") + F.col("ox"), F.col("by") + F.col("oy"), "others").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(*columns, "bx", "by", "ox", "oy", F.col("part").alias("p"), F.col("other").alias("q"), F.lit(0).alias("side"))
    right = parts_of(spread(1), F.col("bx"), F.col("by"), "others").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(*columns, "bx", "by", "ox", "oy", F.col("other").alias("p"), F.col("part").alias("q"), F.lit(1).alias("side"))
    # Of a block with itself each two parts meet once, and a part with itself needs its points once.
    same = (F.col("ox") == 0) & (F.col("oy") == 0)
    both = left.where(~same | (F.col("p") <= F.col("q"))).union(right.where(~same | (F.col("p") < F.col("q"))))

    place, least = [columns.index("x"), columns.index("y")], _WHOLE

    def tiled(values: list[np.ndarray]) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """Values in small squares of some ``_SQUARE`` points, with their bounds: x0, x1, y0, y1."""
        x, y = values[place[0]].astype(float), values[place[1]].astype(float)
        strips = max(1, round(math.sqrt(len(x) / _SQUARE)))
        strip = np.empty(len(x), np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(x)) * strips // len(x)
        order = np.lexsort((y, strip))
        out = []
        for at in np.array_split(order, max(1, len(x) // _SQUARE)):
            out.append(([v[at] for v in values], np.array([x[at].min(), x[at].max(), y[at].min(), y[at].max()])))
        return out

    def nothing(values: list[np.ndarray]) -> pd.DataFrame:
        out = kernel([v[:0] for v in values], [v[:0] for v in values], None)
        return summed(out) if summed else out

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = frame["ox"].iloc[0] == 0 and frame["oy"].iloc[0] == 0 and frame["p"].iloc[0] == frame["q"].iloc[0]
        left = [frame.loc[frame["side"] == 0, c].to_numpy() for c in columns]
        right = left if same else [frame.loc[frame["side"] == 1, c].to_numpy() for c in columns]
        if not len(left[0]) or not len(right[0]):
            return nothing(left)
        at_once = whole(left, right, same) if whole and min(len(left[0]), len(right[0])) >= least else None
        if at_once is not None:
            return summed(at_once)
        lefts = tiled(left)
        rights = lefts if same else tiled(right)
        bounds, parts, total, far = np.array([r for _, r in rights]), [], None, reach * (1 + 1e-9)
        for i, (mine, (x0, x1, y0, y1)) in enumerate(lefts):
            gap_x, gap_y = (np.maximum(0.0, np.maximum(bounds[:, k] - high, low - bounds[:, k + 1])) for k, low, high in ((0, x0, x1), (2, y0, y1)))
            for j in np.flatnonzero(gap_x * gap_x + gap_y * gap_y <= far * far if round_reach else np.maximum(gap_x, gap_y) <= far):
                if same and j < i:
                    continue
                n = len(mine[0])
                part = kernel(mine, rights[j][0], np.arange(n)[:, None] < np.arange(n) if same and j == i else None)
                if summed:
                    total = part if total is None else total + part
                else:
                    parts.append(part)
        if not parts and total is None:
            return nothing(left)
        return summed(total) if summed else pd.concat(parts)

    # Blocks are few bytes but much work, so their number decides the tasks, not their size.
    keys = ["bx", "by", "ox", "oy", "p", "q"]
    groups = -(-b["n"] * len(offsets) // block)
    n = max(points.sparkSession.sparkContext.defaultParallelism, groups if whole else groups // 50, min(groups, groups * block * block // 4_000_000_000))
    return both.repartition(n, *keys).groupBy(*keys).applyInPandas(lambda f: run(f), schema)


def dealt(rows: DataFrame, copies: int = 1) -> int:
    """Into how many tasks to deal rows, each ``copies`` times, for steps that sort them several times over: partitions that are put together by their few bytes on the way are too many rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * copies // _SHARE))


def rounded(c: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
