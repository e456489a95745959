"""Density of mass with a support, on frames whose row 0 lies south (row, col are counted from the lower left corner)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.operators.section import segments


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    cell: float
    ny: int
    nx: int


def points(sources: DataFrame, grid: Grid) -> DataFrame:
    """row, col, mass and weighted sigma of gaussian sources (id, x, y, mass, sigma).

    A source spreads over the cells whose centres lie within three sigmas along each axis (sigma is half a
    cell at least); its weights sum to 1 inside the frame, so mass is kept.
    """
    s = sources.withColumn("s", F.greatest("sigma", F.lit(grid.cell / 2)))
    low = lambda c, o: F.greatest(F.lit(0), F.ceil((F.col(c) - 3 * F.col("s") - o) / grid.cell - 0.5)).cast("int")
    high = lambda c, o, n: F.least(F.lit(n - 1), F.floor((F.col(c) + 3 * F.col("s") - o) / grid.cell - 0.5)).cast("int")
    s = s.withColumn("c0", low("x", grid.x0)).withColumn("c1", high("x", grid.x0, grid.nx)).withColumn("r0", low("y", grid.y0)).withColumn("r1", high("y", grid.y0, grid.ny))
    s = s.where("c1 >= c0 and r1 >= r0").withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    dx, dy = grid.x0 + (F.col("col") + 0.5) * grid.cell - F.col("x"), grid.y0 + (F.col("row") + 0.5) * grid.cell - F.col("y")
    s = s.withColumn("k", F.exp(-(dx * dx + dy * dy) / (2 * F.col("s") * F.col("s"))))
    s = s.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("id")))
    return s.groupBy("row", "col").agg(F.sum(F.col("mass") * F.col("share")).alias("mass"), F.sum(F.col("mass") * F.col("share") * F.col("s")).alias("sigma_mass"))


def lines(vertices: DataFrame, masses: DataFrame, grid: Grid) -> DataFrame:
    """The same for lines (line, seq, x, y) with mass and half-width: points every half cell share a line's mass."""
    s = segments(vertices).where("length > 0").join(masses, "line")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / (grid.cell / 2))).cast("int")
    s = s.withColumn("n", n).withColumn("part", F.col("length") / F.sum("length").over(Window.partitionBy("line"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = (F.col("k") - 0.5) / F.col("n")
    placed = s.select(F.struct("line", "seq", "k").alias("id"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), (F.col("mass") * F.col("part") / F.col("n")).alias("mass"), F.col("halfwidth").alias("sigma"))
    return points(placed, grid)


def inside(rings: DataFrame, grid: Grid) -> DataFrame:
    """polygon, row, col of the cells whose centre an odd number of ring edges (polygon, ring, seq, x, y) lies left of."""
    w = Window.partitionBy("polygon", "ring").orderBy("seq")
    whole = Window.partitionBy("polygon", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = rings.select("polygon", F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1")).where("y0 <> y1")
    first = F.greatest(F.lit(0), F.ceil((F.least("y0", "y1") - grid.y0) / grid.cell - 0.5)).cast("int")
    last = F.least(F.lit(grid.ny - 1), F.ceil((F.greatest("y0", "y1") - grid.y0) / grid.cell - 0.5) - 1).cast("int")
    e = e.withColumn("a", first).withColumn("b", last).where("b >= a").withColumn("row", F.explode(F.sequence("a", "b")))
    y = grid.y0 + (F.col("row") + 0.5) * grid.cell
    at = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    # A crossing at x turns the cells from that place on; two crossings bound a run of cells.
    start = F.greatest(F.lit(0), F.least(F.lit(grid.nx), F.floor((at - grid.x0) / grid.cell - 0.5) + 1)).cast("int")
    cross = e.select("polygon", "row", start.alias("start"))
    order = Window.partitionBy("polygon", "row").orderBy("start")
    runs = cross.withColumn("k", F.row_number().over(order)).withColumn("stop", F.lead("start").over(order)).where("k % 2 = 1 and stop > start")
    return runs.select("polygon", "row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("col"))


def polygons(rings: DataFrame, masses: DataFrame, grid: Grid, weights: DataFrame | None = None) -> DataFrame:
    """row, col, mass and weighted sigma of polygons (``rings``) with mass (polygon, mass): spread evenly over their cells, or by ``weights`` (row, col, w).

    Only positive weights count; a polygon without any is spread evenly. Its sigma is the radius of a circle of its area. Polygons
    without a positive mass, and those that hold no cell's centre, leave nothing.
    """
    held = inside(rings, grid).join(masses.where("mass > 0"), "polygon")
    w = F.lit(None).cast("double")
    if weights is not None:
        held = held.join(weights.select("row", "col", "w"), ["row", "col"], "left")
        w = F.when((F.col("w") > 0) & (F.col("w") < float("inf")), F.col("w")).otherwise(0.0)
    by = Window.partitionBy("polygon")
    n, total = F.count("*").over(by), F.sum(F.coalesce(w, F.lit(0.0))).over(by)
    share = F.when(total > 0, F.try_divide(F.coalesce(w, F.lit(0.0)), total)).otherwise(1 / n)
    held = held.select("row", "col", (F.col("mass") * share).alias("m"), F.sqrt(n * grid.cell * grid.cell / math.pi).alias("s"))
    return held.groupBy("row", "col").agg(F.sum("m").alias("mass"), F.sum(F.col("m") * F.col("s")).alias("sigma_mass"))


def finalise(spread: DataFrame, grid: Grid) -> DataFrame:
    """Density a square kilometre, and the effective sigma, of summed mass."""
    area = grid.cell * grid.cell / 1e6
    return spread.groupBy("row", "col").agg((F.sum("mass") / area).alias("density"), F.try_divide(F.sum("sigma_mass"), F.sum("mass")).alias("sigma"))
