"""Distances to the nearest source at any reach, and surfaces of forms between two lines of known height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.operators.raster import along_col

#: Rows of a frame that one task works on together.
STRIP = 64


def burned(lines: DataFrame, ny: int, nx: int, cell: float = 1.0) -> DataFrame:
    """row, col and z of the cells that lines (line, seq, x, y, z) touch; rows grow with y, heights run along the segments.

    Steps along a segment are half a cell at most. Of several heights in a cell the last one along the lines counts. A line of one vertex is a point; vertices
    without a height are left out.
    """
    w = Window.partitionBy("line").orderBy("seq")
    known = lines.where("z is not null")
    ahead = known.select("line", "seq", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.lead(F.col(c).cast("double")).over(w).alias(f"{c}1") for c in "xyz"], F.count("*").over(Window.partitionBy("line")).alias("n"))
    steps = F.greatest(F.lit(1), (F.sqrt(F.pow(F.col("x1") - F.col("x"), F.lit(2)) + F.pow(F.col("y1") - F.col("y"), F.lit(2))) / cell * 2).cast("int"))
    laid = ahead.where("x1 is not null or n = 1").withColumn("steps", F.coalesce(steps, F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    t = F.when(F.col("steps") > 0, F.col("k") / F.col("steps")).otherwise(0.0)
    at = lambda c: F.col(c) + F.coalesce(t * (F.col(f"{c}1") - F.col(c)), F.lit(0.0))
    put = laid.select(F.rint(at("y") / cell).cast("int").alias("row"), F.rint(at("x") / cell).cast("int").alias("col"), at("z").alias("z"), F.struct("line", "seq", "k").alias("order"))
    inside = F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)
    return put.where(inside).groupBy("row", "col").agg(F.max_by("z", "order").alias("z"))


def _nearest_along(cost: np.ndarray) -> np.ndarray:
    """For each place of each row the place q that makes (place - q)^2 + cost[q] least, the first of equals.

    The best place never goes back as one walks along, so the middle of a stretch bounds both halves; all stretches of a level are
    settled at once.
    """
    m, n = cost.shape
    best = np.zeros((m, n + 2), np.int64)  # places 1 to n, with the bounds on both sides
    best[:, -1] = n - 1
    flat, base = cost.ravel(), np.arange(m) * n
    step = 1 << max(0, (n - 1).bit_length())
    while step:
        at = np.arange(step - 1, n, 2 * step)
        if len(at):
            low, high = best[:, np.maximum(at - step + 1, 0)], best[:, np.minimum(at + step + 1, n + 1)]
            size = (high - low + 1).ravel()
            first = np.cumsum(size) - size
            q = np.arange(size.sum()) - np.repeat(first - low.ravel(), size)
            here = np.repeat(np.tile(at, m), size)
            value = (here - q) ** 2.0 + flat[q + np.repeat(np.repeat(base, len(at)), size)]
            least = np.minimum.reduceat(value, first)
            hit = np.flatnonzero(value == np.repeat(least, size))
            owner = np.searchsorted(first, hit, side="right") - 1
            take = np.r_[True, owner[1:] != owner[:-1]]
            best[:, at + 1] = q[hit[take]].reshape(m, -1)
        step //= 2
    return best[:, 1:-1]


def nearest_source(cells: DataFrame, sources: DataFrame, nx: int) -> DataFrame:
    """row, col, distance (in cells), source_row and source_col of every one of the ``cells`` (row, col, a dense frame) of ``nx`` columns.

    Of equally near sources (row, col) the one in the lesser column counts, then the one in the lesser row. Without a source all three are null.
    Exact at any distance: along columns, windows find the nearest source above and below; along rows, strips of ``STRIP`` rows find the
    column whose own distance and offset add up to least.
    """
    marked = cells.select("row", "col").join(sources.select("row", "col", F.col("row").alias("own")).distinct(), ["row", "col"], "left")
    above = F.last("own", ignorenulls=True).over(along_col().rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("own", ignorenulls=True).over(along_col().rowsBetween(0, Window.unboundedFollowing))
    column = marked.select("row", "col", above.alias("a"), below.alias("b"))
    nearer = F.when(F.col("b").isNull() | (F.col("row") - F.col("a") <= F.col("b") - F.col("row")), F.col("a")).otherwise(F.col("b"))
    column = column.select("row", "col", nearer.cast("int").alias("near"), F.floor(F.col("row") / STRIP).alias("strip"))

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(frame["row"].to_numpy(), return_inverse=True)
        c, near = frame["col"].to_numpy(), frame["near"].to_numpy(float)
        cost, source = np.full((len(rows), nx), 1e15), np.zeros((len(rows), nx), np.int64)
        known = np.isfinite(near)
        cost[r[known], c[known]] = (frame["row"].to_numpy()[known] - near[known]) ** 2
        source[r[known], c[known]] = near[known].astype(np.int64)
        best = _nearest_along(cost)
        d2 = (np.arange(nx) - best) ** 2.0 + np.take_along_axis(cost, best, 1)
        got = pd.DataFrame({"row": frame["row"], "col": c, "distance": np.sqrt(d2[r, c]), "source_row": np.take_along_axis(source, best, 1)[r, c], "source_col": best[r, c]})
        far = d2[r, c] >= 1e15
        return got.astype({"source_row": "Int32", "source_col": "Int32"}).mask(far[:, None] & ~got.columns.isin(["row", "col"]))

    return column.groupBy("strip").applyInPandas(along, "row int, col int, distance double, source_row int, source_col int")


def form_surface(cells: DataFrame, top: DataFrame, bottom: DataFrame, nx: int, smooth: bool = False, slack: float = 1.05) -> DataFrame:
    """row, col, z, alpha, d_top, d_bottom, seam, body and border of a form between a top and a bottom (both row, col, z).

    ``alpha`` is the top's share, by the distances to both (with ``smooth`` eased in and out for z); where both sides are in the same cell it is a
    half. ``seam`` is how much they disagree where they come within a cell. The body is where the distances add up to no more
    than the form's width at the nearest cell of the top (``slack`` times it, and a cell and a half); its border has a neighbour outside. Without
    a top or a bottom all is null and there is no body.
    """
    sides = {}
    for name, side in (("top", top), ("bottom", bottom)):
        near = nearest_source(cells, side, nx)
        heights = side.select(F.col("row").alias("source_row"), F.col("col").alias("source_col"), F.col("z").alias(f"z_{name}"))
        sides[name] = near.join(heights, ["source_row", "source_col"], "left").withColumnRenamed("distance", f"d_{name}")
    t = sides["top"].withColumnsRenamed({"source_row": "tr", "source_col": "tc"}).join(sides["bottom"].drop("source_row", "source_col"), ["row", "col"])
    t = checkpointed(t)
    width = t.where("d_top = 0").select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("d_bottom").alias("width"))
    t = t.join(width, ["tr", "tc"], "left")
    total = F.col("d_top") + F.col("d_bottom")
    alpha = F.when(total > 1e-12, F.col("d_bottom") / total).otherwise(F.when(total.isNotNull(), 0.5))
    share = alpha * alpha * (3 - 2 * alpha) if smooth else alpha
    z = share * F.col("z_top") + (1 - share) * F.col("z_bottom")
    seam = F.when((F.col("d_top") < 1) & (F.col("d_bottom") < 1), F.abs(F.col("z_top") - F.col("z_bottom"))).otherwise(0.0)
    body = F.coalesce(total <= F.col("width") * slack + 1.5, F.lit(False))
    found = checkpointed(t.select("row", "col", z.alias("z"), alpha.alias("alpha"), "d_top", "d_bottom", seam.alias("seam"), body.alias("body")))
    around = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("p")
    inner = found.where("body").select(around).groupBy("p.row", "p.col").agg(F.count("*").alias("n")).where("n = 9").select("row", "col", F.lit(True).alias("inner"))
    return found.join(inner, ["row", "col"], "left").withColumn("border", F.col("body") & F.col("inner").isNull()).drop("inner")
