"""Subsidence troughs on grids: the model trough of a working, and deformations of a settled surface."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions.scalar import CURVATURE, TILT, half_trough, reduction, trough_shape
from orogen.operators.raster import along_col, along_row


def trough(spark: SparkSession, ny: int, nx: int, cell: float, depth: float, length: float, width: float, most: float, boundary: float = 55.0, full: float = 55.0) -> DataFrame:
    """row, col and z (settlement, positive downwards) over a working in the frame's middle, ``length`` along rows and ``width`` across.

    Over the working less the angle of full subsidence the bottom is flat; from its edge each axis falls off by ``trough_shape``
    over the half-trough's length, and the settlement is the product of both.
    """
    away = depth / math.tan(math.radians(full))
    reach = half_trough(F.lit(float(depth)), boundary, full)

    def share(index: Column, n: int, size: float) -> Column:
        middle = F.abs((index + 0.5) * cell - n * cell / 2)
        return trough_shape(F.greatest(middle - max(0.0, size / 2 - away), F.lit(0.0)) / reach)

    cells = spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return cells.select("row", "col", (most * share(F.col("row"), ny, width) * share(F.col("col"), nx, length)).alias("z"))


def deformations(cells: DataFrame, ny: int, nx: int, cell: float, base: float, reduce: bool = True) -> DataFrame:
    """row, col, tilt, azimuth, and curvatures k_dir, k_max, k_min with the azimuth of k_max, of settlements on a dense frame.

    Differences are taken over ``base`` metres, as between marks, whatever the cell: tilts between places half a base away on
    either side, curvatures over a base, the mixed one from the corners of a square. Places between centres are
    interpolated; where one lies off the frame or on nodata the value is null. With ``reduce``, tilts and
    curvatures are brought to 15 m. The azimuth points to where settlement grows. Every place is a fixed mix of shifted cells, so windows along both axes do it.
    """
    h = base / cell

    def mix(shift: float) -> list[tuple[int, float]]:
        low = math.floor(shift)
        part = shift - low
        return [(low, 1 - part), (low + 1, part)] if part > 1e-12 else [(low, 1.0)]

    def moved(c: str, k: int, w) -> Column:
        return F.col(c) if k == 0 else (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)

    places = {"ep": (0, h / 2), "em": (0, -h / 2), "np": (-h / 2, 0), "nm": (h / 2, 0), "e2": (0, h), "w2": (0, -h), "n2": (-h, 0), "s2": (h, 0)}
    places |= {"ne": (-h / 2, h / 2), "se": (h / 2, h / 2), "nw": (-h / 2, -h / 2), "sw": (h / 2, -h / 2)}
    across = sorted({dc for _, dc in places.values()})
    t = cells.select("row", "col", F.col("z").cast("double").alias("z"))
    t = t.select("*", *[sum((k * moved("z", i, along_row()) for i, k in mix(dc)), F.lit(0.0)).alias(f"c{n}") for n, dc in enumerate(across)])
    t = t.select("row", "col", "z", *[sum((k * moved(f"c{across.index(dc)}", i, along_col()) for i, k in mix(dr)), F.lit(0.0)).alias(name) for name, (dr, dc) in places.items()])
    c = F.col
    qi, qk = (reduction(F.lit(base), TILT), reduction(F.lit(base), CURVATURE)) if reduce else (F.lit(1.0), F.lit(1.0))
    gx, gy = (c("ep") - c("em")) / base, (c("np") - c("nm")) / base
    bend = lambda a, b: (c(a) - 2 * c("z") + c(b)) / base**2 * qi * qk
    mixed = (c("ne") - c("se") - c("nw") + c("sw")) / base**2 * qi * qk
    t = t.select("row", "col", gx.alias("gx"), gy.alias("gy"), bend("e2", "w2").alias("xx"), bend("n2", "s2").alias("yy"), mixed.alias("xy"))
    size = F.sqrt(c("gx") * c("gx") + c("gy") * c("gy"))
    tilt, mean = size * qi, 0.5 * (c("xx") + c("yy"))
    ux, uy = F.try_divide(c("gx"), size), F.try_divide(c("gy"), size)
    along = c("xx") * ux * ux + 2 * c("xy") * ux * uy + c("yy") * uy * uy
    spread = F.sqrt(F.greatest(0.25 * (c("xx") - c("yy")) * (c("xx") - c("yy")) + c("xy") * c("xy"), F.lit(0.0)))
    principal = F.pmod(90 - F.degrees(0.5 * F.atan2(2 * c("xy"), c("xx") - c("yy"))), F.lit(180.0))
    spread = F.when(c("xx").isNotNull() & c("yy").isNotNull() & c("xy").isNotNull(), spread)
    return t.select(
        "row", "col", tilt.alias("tilt"), F.when(tilt > 1e-12, F.pmod(F.degrees(F.atan2("gx", "gy")), F.lit(360.0))).alias("azimuth"),
        F.coalesce(along, mean).alias("k_dir"), (mean + spread).alias("k_max"), (mean - spread).alias("k_min"), principal.alias("k_max_az"),
    )
