"""Fractal dimensions and scale-dependent roughness of rasters, masks and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.joins import dealt
from orogen.operators.raster import along_col, along_row


def box_counts(mask: DataFrame, ny: int, nx: int, largest: int | None = None) -> DataFrame:
    """size and boxes that hold a mask cell (row, col): sizes 2, 4 .. to an eighth of the shorter side, ragged edges left out, counts over 4.

    ``largest`` bounds the sizes; None sets no bound.
    """
    top = max(min(ny, nx) // 8, 2)
    top = min(top, largest or top).bit_length() - 1
    sizes = [2**k for k in range(1, top + 1) if 2**k <= min(ny, nx)] or [2]
    laid = mask.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    whole = (F.col("row") < (F.lit(ny) - F.lit(ny) % F.col("size"))) & (F.col("col") < (F.lit(nx) - F.lit(nx) % F.col("size")))
    return laid.where(whole).select("size", F.floor(F.col("row") / F.col("size")).alias("r"), F.floor(F.col("col") / F.col("size")).alias("c")).distinct().groupBy("size").agg(F.count("*").alias("n")).where("n > 4")


def box_dimension(counts: DataFrame) -> DataFrame:
    return counts.agg((-F.regr_slope(F.log("n"), F.log("size"))).alias("dimension"), F.count("*").alias("n_sizes"))


def minkowski_counts(samples: DataFrame, sizes: list[float], shifts: list[tuple[float, float]]) -> DataFrame:
    """size and the fewest cells that hold a sample (x, y) over the given shifts of the grid (shares of a cell).

    Places and the cells they lie in are dealt by their number, as a task holds its distinct cells in memory.
    """
    n = dealt(samples, len(sizes) * len(shifts))
    places = samples.select("x", "y").repartition(n, "x", "y").distinct()
    laid = places.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes]))).withColumn("k", F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(shifts)])))
    cell = lambda c, s: F.floor(F.col(c) / F.col("size") + F.col(s)).alias(c)
    counts = laid.select("size", "k.i", cell("x", "k.a"), cell("y", "k.b")).repartition(n, "size", "i", "x", "y").distinct().groupBy("size", "i").agg(F.count("*").alias("n"))
    return counts.groupBy("size").agg(F.min("n").alias("n"))


def dimension_map(cells: DataFrame, radius: int, max_lag: int = 4, least: int = 32) -> DataFrame:
    """row, col, dimension and hurst: 3 - half the slope of log variogram on log lag, over the window of ``radius`` around each cell.

    A pair of cells along a row or column counts at both of them; windows are clipped at the edge. Every
    lag from 1 to ``max_lag`` needs ``least`` pairs and a positive variogram, else the cell has no dimension, nor has
    one without a height. Dimensions are held to 2 to 3, exponents to 0 to 1.
    """
    lags = range(1, max_lag + 1)
    z = F.col("z")
    around = {h: [step("z", h).over(w) - z for step in (F.lead, F.lag) for w in (along_row(), along_col())] for h in lags}
    flat = cells.select("row", "col", "z", *[d.alias(f"d{h}_{k}") for h in lags for k, d in enumerate(around[h])])
    square = lambda h: sum((F.coalesce(F.col(f"d{h}_{k}") * F.col(f"d{h}_{k}"), F.lit(0.0)) for k in range(4)), F.lit(0.0))
    known = lambda h: sum((F.col(f"d{h}_{k}").isNotNull().cast("int") for k in range(4)), F.lit(0))
    both = flat.select("row", "col", "z", *[square(h).alias(f"s{h}") for h in lags], *[known(h).alias(f"n{h}") for h in lags])
    names = [f"{p}{h}" for h in lags for p in "sn"]
    for w in (along_row(), along_col()):
        both = both.select("row", "col", "z", *[F.sum(c).over(w.rowsBetween(-radius, radius)).alias(c) for c in names])
    sound = z.isNotNull()
    for h in lags:
        sound = sound & (F.col(f"n{h}") >= least) & (F.col(f"s{h}") > 0)
    x = np.log(np.arange(1, max_lag + 1))
    x = (x - x.mean()) / ((x - x.mean()) ** 2).sum()
    slope = sum((float(x[h - 1]) * F.log(F.col(f"s{h}") / (2 * F.col(f"n{h}"))) for h in lags), F.lit(0.0))
    held = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return both.where(sound).select("row", "col", held(3 - slope / 2, 2.0, 3.0).alias("dimension"), held(slope / 2, 0.0, 1.0).alias("hurst"))


def _mirrored(cells: DataFrame, axis: str, n: int, radius: int) -> DataFrame:
    """Cells with ``at``, their place along an axis, and copies of the cells near its ends mirrored beyond them; the end itself isn't repeated."""
    c = F.col(axis)
    places = F.array(c, F.when(c.between(1, radius), -c), F.when(c.between(n - 1 - radius, n - 2), 2 * (n - 1) - c))
    return cells.withColumn("at", F.explode(F.filter(places, lambda p: p.isNotNull())))


def detrended_variance(cells: DataFrame, ny: int, nx: int, radius: int) -> DataFrame:
    """row, col, variance of z about the plane fitted to the window of ``radius``, which mirrors at the frame's edge; four known cells at least.

    Mirrored cells keep the coordinates of the cell that they repeat. Nine window sums give the normal
    equations, solved by Cramer's rule in columns; without a plane (a determinant of 1e-9 or less) it is the plain variance.
    """
    if radius >= min(ny, nx):
        raise ValueError("the window is wider than the frame")
    x, y, z = F.col("col").cast("double"), F.col("row").cast("double"), F.col("z")
    terms = {"k": F.lit(1.0), "x": x, "y": y, "z": z, "xx": x * x, "yy": y * y, "xy": x * y, "xz": x * z, "yz": y * z, "zz": z * z}
    s = cells.select("row", "col", "z", *[F.when(z.isNotNull(), e).otherwise(0.0).alias(f"s_{n}") for n, e in terms.items()])
    for axis, across, n in (("col", "row", nx), ("row", "col", ny)):
        w = Window.partitionBy(across).orderBy("at").rowsBetween(-radius, radius)
        s = _mirrored(s, axis, n, radius).select("row", "col", "z", "at", *[F.sum(f"s_{t}").over(w).alias(f"s_{t}") for t in terms]).where(F.col("at") == F.col(axis)).drop("at")
    c = lambda n: F.col(f"s_{n}")
    cov = lambda a, b, ab: c(ab) - c(a) * c(b) / c("k")
    moments = {"xx": ("x", "x"), "yy": ("y", "y"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z"), "zz": ("z", "z")}
    s = s.where("s_k >= 4 and z is not null").select("row", "col", "s_k", *[cov(*ab, n).alias(n) for n, ab in moments.items()])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    tilt = lambda a, b, d: F.when(F.abs(det) > 1e-9, F.try_divide(F.col(a) * F.col(d) - F.col(b) * F.col("xy"), det)).otherwise(0.0)
    left = F.col("zz") - tilt("xz", "yz", "yy") * F.col("xz") - tilt("yz", "xz", "xx") * F.col("yz")
    return s.select("row", "col", (F.greatest(F.lit(0.0), left) / F.col("s_k")).alias("variance"))


def scale_slope(cells: DataFrame, ny: int, nx: int, radii: list[int]) -> DataFrame:
    """row, col, slope of log detrended variance (1e-12 at least) on log window over ``radii``, of cells that have one in every window."""
    if len(radii) < 2:
        raise ValueError("two windows at least")
    parts = None
    for r in radii:
        one = detrended_variance(cells, ny, nx, r).select("row", "col", F.lit(float(2 * r + 1)).alias("win"), F.greatest("variance", F.lit(1e-12)).alias("variance"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("row", "col").agg(F.regr_slope(F.log("variance"), F.log("win")).alias("slope"), F.count("*").alias("k")).where(F.col("k") == len(radii)).drop("k")


def divider(lines: DataFrame, rulers: int = 6) -> DataFrame:
    """line, n_rulers and dimension of polylines (line, seq, x, y), walked with dividers; a line is one group.

    Rulers are log-spaced from a 200th to an eighth of the line's length. A step ends at the first place a ruler
    away, and only whole steps count. The slope takes three rulers at least of two steps at least.
    """
    def walk(p: np.ndarray, r: float) -> int:
        here, seg, n = p[0], 0, 0
        while True:
            k = seg
            while k < len(p) - 1 and np.hypot(*(p[k + 1] - here)) < r:
                k += 1
            if k == len(p) - 1:
                return n
            a = p[k] if k > seg else here
            d, f = p[k + 1] - a, a - here
            q, l, c = d @ d, f @ d, f @ f - r * r
            here, seg, n = a + (-l + np.sqrt(max(l * l - q * c, 0))) / q * d, k, n + 1

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        p = frame.sort_values("seq")[["x", "y"]].to_numpy(float)
        p = p[np.concatenate(([True], np.any(np.diff(p, axis=0) != 0, 1)))]
        found, dimension = [], None
        if len(p) > 1:
            length = np.hypot(*np.diff(p, axis=0).T).sum()
            found = [(r, n) for r in np.geomspace(length / 200, length / 8, rulers) if (n := walk(p, r)) >= 2]
            if len(found) >= 3:
                dimension = -np.polyfit(*np.log(np.array(found, float)).T, 1)[0]
        return pd.DataFrame({"line": frame["line"].iloc[:1], "n_rulers": [len(found)], "dimension": [dimension]})

    schema = f"line {dict(lines.dtypes)['line']}, n_rulers int, dimension double"
    return lines.groupBy("line").applyInPandas(lambda f: one(f), schema)
