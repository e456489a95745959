"""Rasters as rows of (row, col, z): row 0 lies north, null is nodata, an absent cell lies outside the frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orogen.functions.joins import near_join
from orogen.functions.loops import checkpointed, fixpoint, least_reached
from orogen.functions.ranks import quantiles

#: Neighbours as (name, row step, column step), clockwise from east.
NEIGHBOURS = [("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1)]

#: Masked cells whose patches are a group together.
_LOT = 20_000


def along_row() -> WindowSpec:
    return Window.partitionBy("row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("col").orderBy("row")


def frame(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns of the frame."""
    top = cells.agg(F.max("row"), F.max("col")).first()
    return (top[0] if top[0] is not None else -1) + 1, (top[1] if top[1] is not None else -1) + 1


def dense(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """All cells of the frame; those without a row get a null z. The frame is never broadcast, as estimates don't tell its size."""
    every = cells.sparkSession.range(ny).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("col"))
    return every.hint("merge").join(cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z"), ["row", "col"], "left")


def stencil(cells: DataFrame, ny: int, nx: int, replicate: bool = False) -> DataFrame:
    """A dense frame's cells with their eight neighbours (``e`` .. ``ne``).

    Off the frame a neighbour is null, or with ``replicate`` the edge's own value. A corner is a
    neighbour's neighbour, so two windows do: one along rows and one along columns.
    """
    west = F.when(F.col("col") == 0, F.col("z") if replicate else F.lit(None)).otherwise(F.lag("z").over(along_row()))
    east = F.when(F.col("col") == nx - 1, F.col("z") if replicate else F.lit(None)).otherwise(F.lead("z").over(along_row()))
    wide = cells.withColumn("w", west).withColumn("e", east)
    up = lambda c: F.when(F.col("row") == 0, F.col(c) if replicate else F.lit(None)).otherwise(F.lag(c).over(along_col()))
    down = lambda c: F.when(F.col("row") == ny - 1, F.col(c) if replicate else F.lit(None)).otherwise(F.lead(c).over(along_col()))
    return wide.select("*", up("w").alias("nw"), up("z").alias("n"), up("e").alias("ne"), down("w").alias("sw"), down("z").alias("s"), down("e").alias("se"))


def slope_aspect(cells: DataFrame, ny: int, nx: int, cell: float) -> DataFrame:
    """Slope and aspect in degrees by Horn's 3 x 3 weights on an edge-replicated frame; nodata spreads, flat aspect is -1."""
    s = stencil(cells, ny, nx, True)
    c = F.col
    dzdx = ((c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))) / (8 * cell)
    dzdy = ((c("nw") + 2 * c("n") + c("ne")) - (c("sw") + 2 * c("s") + c("se"))) / (8 * cell)
    s = s.withColumn("gx", dzdx).withColumn("gy", dzdy).where("z is not null")
    down = F.degrees(F.atan2(-c("gx"), -c("gy")))
    aspect = F.when((c("gx") == 0) & (c("gy") == 0), -1.0).when(down < 0, down + 360).otherwise(down)
    return s.select("row", "col", F.degrees(F.atan(F.sqrt(c("gx") ** 2 + c("gy") ** 2))).alias("slope"), aspect.alias("aspect"))


def gradient(cells: DataFrame, ny: int, nx: int, cell: float) -> DataFrame:
    """Magnitude and azimuth of the falling gradient by central differences, one-sided at the frame's edge; nodata spreads."""
    s = stencil(cells, ny, nx)
    c = F.col
    dx = F.when(c("col") == 0, c("e") - c("z")).when(c("col") == nx - 1, c("z") - c("w")).otherwise((c("e") - c("w")) / 2) / cell
    dy = F.when(c("row") == 0, c("z") - c("s")).when(c("row") == ny - 1, c("n") - c("z")).otherwise((c("n") - c("s")) / 2) / cell
    s = s.withColumn("gx", dx).withColumn("gy", dy).where("z is not null and gx is not null and gy is not null")
    return s.select("row", "col", F.sqrt(c("gx") ** 2 + c("gy") ** 2).alias("magnitude"), F.pmod(F.degrees(F.atan2(-c("gx"), -c("gy"))), F.lit(360.0)).alias("azimuth"))


def darcy(gradients: DataFrame, conductivity: float) -> DataFrame:
    """Specific discharge conductivity * |grad h| along the gradient."""
    return gradients.withColumn("discharge", F.col("magnitude") * conductivity)


def profile_curvature(cells: DataFrame, ny: int, nx: int, cell: float) -> DataFrame:
    """Curvature along the slope (Zevenbergen and Thorne), positive where convex; interior cells with a slope only."""
    s = stencil(cells, ny, nx)
    c = F.col
    p, q = (c("e") - c("w")) / (2 * cell), (c("n") - c("s")) / (2 * cell)
    r, t = (c("e") - 2 * c("z") + c("w")) / cell**2, (c("n") - 2 * c("z") + c("s")) / cell**2
    st = (c("ne") - c("nw") - c("se") + c("sw")) / (4 * cell**2)
    s = s.withColumn("p", p).withColumn("q", q).withColumn("r", r).withColumn("t", t).withColumn("st", st)
    g = c("p") ** 2 + c("q") ** 2
    k = F.try_divide(-(c("r") * c("p") ** 2 + 2 * c("st") * c("p") * c("q") + c("t") * c("q") ** 2), g * F.pow(1 + g, F.lit(1.5)))
    return s.where("nw is not null and ne is not null and sw is not null and se is not null and n is not null and s is not null and e is not null and w is not null and z is not null").where(g >= 1e-12).select("row", "col", k.alias("curvature"))


def window_range(cells: DataFrame, radius: int) -> DataFrame:
    """Cells with the highest and lowest z of the square window of ``radius`` cells, axis by axis."""
    along = lambda w: w.rowsBetween(-radius, radius)
    part = cells.withColumn("h", F.max("z").over(along(along_row()))).withColumn("l", F.min("z").over(along(along_row())))
    return part.select("row", "col", "z", F.max("h").over(along(along_col())).alias("high"), F.min("l").over(along(along_col())).alias("low"))


def peaks(cells: DataFrame, radius: int, least_drop: float, tile: int = 256, rounds: int = 10_000) -> DataFrame:
    """Cells that no cell of their window exceeds and that rise ``least_drop`` above its lowest, none in reach of another.

    Candidates in reach of one another are equally high. They are taken from north to south and west to east: one stays unless one
    that stays is in its window, so a wide plateau keeps a peak for each window. Tiles decide all cells whose earlier
    neighbours are decided, with a halo as wide as the window, until none is left; only plateaus across tiles take rounds.
    """
    drop = F.col("z") - F.col("low")
    found = window_range(cells, radius).where((F.col("z") >= F.col("high")) & (drop >= least_drop)).select("row", "col", "z", drop.alias("drop"), F.lit(0).alias("stays"))

    def decided(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"])
        r, c = frame["row"].to_numpy() - key[0] * tile + radius, frame["col"].to_numpy() - key[1] * tile + radius
        state = np.full((tile + 2 * radius, tile + 2 * radius), -2)
        state[r, c] = frame["stays"].to_numpy()  # 1 stays, -1 goes, 0 is open, -2 is no candidate
        own = (r >= radius) & (r < tile + radius) & (c >= radius) & (c < tile + radius)
        for i, j in zip(r[own & (state[r, c] == 0)].tolist(), c[own & (state[r, c] == 0)].tolist(), strict=True):
            window = state[i - radius : i + radius + 1, j - radius : j + radius + 1]
            if (window == 1).any():
                state[i, j] = -1
            elif not (window[:radius] == 0).any() and not (window[radius, :radius] == 0).any():
                state[i, j] = 1
        return frame.assign(stays=state[r, c].astype("int32"))[own][["row", "col", "z", "drop", "stays"]]

    step = lambda t: tiles(t, tile, radius).groupBy("tr", "tc").applyInPandas(decided, found.schema)
    return fixpoint(found, step, lambda t: t.where("stays = 0"), rounds).where("stays = 1").drop("stays")


def extremes(cells: DataFrame, radius: int, least_drop: float) -> DataFrame:
    """row, col, z, drop and kind of peaks and pits, the largest drops first; a pit is a peak of the surface upside down."""
    down = peaks(cells.withColumn("z", -F.col("z")), radius, least_drop).withColumn("z", -F.col("z"))
    both = peaks(cells, radius, least_drop).withColumn("kind", F.lit("peak")).union(down.withColumn("kind", F.lit("pit")))
    return both.orderBy(F.desc("drop"), "row", "col")


def cut_fill(before: DataFrame, after: DataFrame, cell: float, dead: float = 0.0) -> DataFrame:
    """cut and fill volumes, areas, largest and mean depth, flat area and cells without a difference; depths count beyond ``dead`` only."""
    both = before.select("row", "col", F.col("z").alias("z0")).join(after.select("row", "col", F.col("z").alias("z1")), ["row", "col"], "full")
    d, area = F.col("z1") - F.col("z0"), cell * cell
    side = lambda sign, name: [
        F.coalesce(F.sum(F.when(sign * d > dead, sign * d * area)), F.lit(0.0)).alias(f"{name}_volume"),
        (F.count_if(sign * d > dead) * area).alias(f"{name}_area"),
        F.max(F.when(sign * d > dead, sign * d)).alias(f"{name}_max"),
        F.avg(F.when(sign * d > dead, sign * d)).alias(f"{name}_mean"),
    ]
    return both.agg(*side(-1, "cut"), *side(1, "fill"), (F.count_if(F.abs(d) <= dead) * area).alias("flat_area"), F.count_if(d.isNull()).alias("nodata"))


def zone_stats(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Count, sum, mean and extremes of z for each zone but 0."""
    return cells.where("z is not null").join(zones.where("zone <> 0"), ["row", "col"]).groupBy("zone").agg(F.count("*").alias("n"), F.sum("z").alias("total"), F.avg("z").alias("mean"), F.min("z").alias("least"), F.max("z").alias("most"))


def sample(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` (id, x, y in cells; a cell's centre is its index + 0.5) with z interpolated between four centres; null where one is missing."""
    fx, fy = F.col("x") - 0.5, F.col("y") - 0.5
    placed = points.withColumn("c0", F.floor(fx).cast("int")).withColumn("r0", F.floor(fy).cast("int")).withColumn("tx", fx - F.floor(fx)).withColumn("ty", fy - F.floor(fy))
    corner = F.explode(F.array(*[F.struct((F.col("r0") + i).alias("row"), (F.col("c0") + j).alias("col"), ((F.col("ty") if i else 1 - F.col("ty")) * (F.col("tx") if j else 1 - F.col("tx"))).alias("k")) for i in (0, 1) for j in (0, 1)]))
    parts = placed.select("id", corner.alias("p")).select("id", "p.row", "p.col", "p.k")
    got = parts.join(cells, ["row", "col"], "left").groupBy("id").agg(F.when(F.count("z") == 4, F.sum(F.col("z") * F.col("k"))).alias("z"))
    return points.join(got, "id")


def residual_stats(table: DataFrame, residual: str, interval: float) -> DataFrame:
    """Summary of residuals; spread has n - 1 below it and is 0 for one row. Quantiles are exact at any size (``quantiles``)."""
    r, a = F.col(residual), F.abs(F.col(residual))
    median, p90 = quantiles(table, a, [0.5, 0.9])
    return table.where(r.isNotNull()).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.lit(median).cast("double").alias("median_abs"), F.lit(p90).cast("double").alias("p90_abs"), F.max(a).alias("max_abs"),
        F.avg((a > 0.5 * interval).cast("double")).alias("over_half"), F.avg((a > interval).cast("double")).alias("over_full"),
    )


def residuals_by_level(table: DataFrame, level: str, residual: str) -> DataFrame:
    r = F.col(residual)
    return table.where(r.isNotNull()).groupBy(level).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"), F.max(F.abs(r)).alias("max_abs"))


def histogram(table: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0; the last edge is closed) and count of values between the extremes."""
    b = table.agg(F.min(value), F.max(value)).first()
    if b[0] is None:
        return table.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (b[1] - b[0]) / bins or 1.0
    return table.where(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - b[0]) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def phase(z: Column, base: float, interval: float) -> Column:
    """Where a height lies between two contours: -0.5 to 0.5, 0 on a contour."""
    t = (z - base) / interval + 0.5
    return t - F.floor(t) - 0.5


def level_attraction(cells: DataFrame, base: float, interval: float, band: float) -> DataFrame:
    """Share of heights within ``band`` of a contour over the share that an even spread has; 1 is no terracing."""
    near = F.abs(phase(F.col("z"), base, interval)) <= band
    return cells.where("z is not null").agg(F.count("*").alias("n"), (F.avg(near.cast("double")) / (2 * band)).alias("attraction"))


def tiles(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Cells under every square tile (tr, tc) of ``tile`` cells that holds them or has them within ``halo`` cells of its edge."""
    around = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return cells.withColumn("tr", F.explode(around("row"))).withColumn("tc", F.explode(around("col")))


def smooth_clamped(cells: DataFrame, ny: int, nx: int, interval: float, rounds: int = 50, band: float = 0.5, tile: int = 256) -> DataFrame:
    """``rounds`` of (4 own + neighbours) / (4 + their number), each held within ``band`` contour intervals of the first height.

    Nulls neither change nor spread. Beyond the frame's edge the surface goes on at its slope: the
    neighbour there is twice the edge cell less the one inside, in height and in weight. A pass over tiles makes up to
    16 rounds in a task, with as many cells around each tile, and is one shuffle.
    """
    if not interval > 0:
        raise ValueError("the interval must be positive")
    limit = band * interval
    now = cells.select("row", "col", F.col("z").cast("double").alias("z"), F.col("z").cast("double").alias("z0"))
    done = 0
    while done < rounds:
        halo = min(16, rounds - done)
        done += halo

        def smoothed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            r0, c0 = max(0, key[0] * tile - halo), max(0, key[1] * tile - halo)
            r1, c1 = min(ny, (key[0] + 1) * tile + halo), min(nx, (key[1] + 1) * tile + halo)
            z, first = np.full((r1 - r0, c1 - c0), np.nan), np.full((r1 - r0, c1 - c0), np.nan)
            at = (frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0)
            z[at], first[at] = frame["z"].to_numpy(float), frame["z0"].to_numpy(float)
            known = np.isfinite(z)
            z = np.where(known, z, 0.0)
            weight = np.maximum(_around(known.astype(float)) + 4.0 * known, 1e-12)
            for _ in range(halo):
                z = np.where(known, np.clip((_around(z) + 4.0 * z) / weight, first - limit, first + limit), 0.0)
            own = (frame["row"] // tile == key[0]) & (frame["col"] // tile == key[1])
            return frame[own].assign(z=np.where(known[at], z[at], np.nan)[own.to_numpy()])[["row", "col", "z", "z0"]]

        # Run at once, so the function's halo is this pass's.
        now = checkpointed(tiles(now, tile, halo).groupBy("tr", "tc").applyInPandas(smoothed, now.schema))
    return now.select("row", "col", F.when(~F.isnan("z"), F.col("z")).alias("z"))


def _around(a: np.ndarray) -> np.ndarray:
    """Sum of each cell's four neighbours; beyond an edge, twice the edge less the cell inside it."""
    up, down, left, right = np.empty_like(a), np.empty_like(a), np.empty_like(a), np.empty_like(a)
    up[1:], down[:-1], left[:, 1:], right[:, :-1] = a[:-1], a[1:], a[:, :-1], a[:, 1:]
    rows, cols = len(a) > 1, a.shape[1] > 1
    up[0], down[-1] = (2 * a[0] - a[1], 2 * a[-1] - a[-2]) if rows else (a[0], a[-1])
    left[:, 0], right[:, -1] = (2 * a[:, 0] - a[:, 1], 2 * a[:, -1] - a[:, -2]) if cols else (a[:, 0], a[:, -1])
    return up + down + left + right


def contour_segments(cells: DataFrame, ny: int, nx: int, levels: list[float]) -> DataFrame:
    """level, case and directed segments (x0, y0, x1, y1 in cells) of contours by marching squares over squares of four known centres.

    A corner at the level counts as above it. Saddles are settled by the mean of the corners. Seen along a segment, with rows
    going down, the ground above lies on its right. ``n0`` and ``n1`` number the grid lines between two centres on which it begins and ends.
    """
    s = stencil(cells, ny, nx).where("z is not null and e is not null and s is not null and se is not null")
    s = s.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    c, v = F.col, F.col("level")
    t = lambda a, b: F.try_divide(v - c(a), c(b) - c(a))
    x, y = c("col") + 0.5, c("row") + 0.5
    across, down = (c("row") * nx + c("col")).cast("double") * 2, (c("row") * nx + c("col")).cast("double") * 2 + 1
    edge = {
        "N": (x + t("z", "e"), y + F.lit(0.0), across), "E": (x + 1.0, y + t("e", "se"), down + 2),
        "S": (x + t("s", "se"), y + 1.0, across + 2 * nx), "W": (x + F.lit(0.0), y + t("z", "s"), down),
    }
    up = lambda k: (c(k) >= v)
    # For each pair of sides, a corner that lies on the right of the way from the first to the second.
    corner = {"NW": "z", "WS": "s", "SE": "se", "EN": "e", "NS": "z", "EW": "z"}

    def line(a: str, b: str) -> Column:
        a, b = (a, b) if a + b in corner else (b, a)
        go = lambda p, q: F.array(*edge[p], *edge[q])
        return F.when(up(corner[a + b]), go(a, b)).otherwise(go(b, a))

    case = up("z").cast("int") * 8 + up("e").cast("int") * 4 + up("se").cast("int") * 2 + up("s").cast("int")
    mean = (c("z") + c("e") + c("s") + c("se")) / 4 >= v
    one = {1: "SW", 2: "ES", 3: "EW", 4: "NE", 6: "NS", 7: "NW", 8: "NW", 9: "NS", 11: "NE", 12: "EW", 13: "ES", 14: "SW"}
    out = F.when(case.isin(0, 15), F.array().cast("array<array<double>>"))
    for k, (a, b) in one.items():
        out = out.when(case == k, F.array(line(a, b)))
    out = out.when(case == 5, F.when(mean, F.array(line("N", "W"), line("E", "S"))).otherwise(F.array(line("N", "E"), line("S", "W"))))
    out = out.when(case == 10, F.when(mean, F.array(line("N", "E"), line("S", "W"))).otherwise(F.array(line("N", "W"), line("E", "S"))))
    got = s.withColumn("case", case).select("level", "case", F.explode(out).alias("p"))
    names = ("x0", "y0", "n0", "x1", "y1", "n1")
    got = got.select("level", "case", *[F.col("p")[k].alias(n) for k, n in enumerate(names)])
    return got.withColumns({n: F.col(n).cast("long") for n in ("n0", "n1")})


def above_levels(cells: DataFrame, ny: int, nx: int, levels: list[float], cell: float) -> DataFrame:
    """level, area and volume of the ground above each level: exact over two triangles for each square of four known centres.

    A triangle's corners in rising order a, b, c cut by a level leave a part of its area, and of its volume, in closed form. Bands between levels are differences.
    """
    s = stencil(cells, ny, nx).where("z is not null and e is not null and s is not null and se is not null")
    corners = F.explode(F.array(F.array_sort(F.array("z", "e", "se")), F.array_sort(F.array("z", "s", "se")))).alias("t")
    t = s.select(corners).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"), F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    a, b, c, v = (F.col(k) for k in ("a", "b", "c", "level"))
    third = (a + b + c) / 3 - v
    low, high = F.try_divide((v - a) * (v - a), (b - a) * (c - a)), F.try_divide((c - v) * (c - v), (c - a) * (c - b))
    area = F.when(v <= a, 1.0).when(v <= b, 1 - low).when(v < c, high).otherwise(0.0)
    volume = F.when(v <= a, third).when(v <= b, third + low * (v - a) / 3).when(v < c, high * (c - v) / 3).otherwise(0.0)
    return t.groupBy("level").agg((F.sum(area) * cell * cell / 2).alias("area"), (F.sum(volume) * cell * cell / 2).alias("volume"))


def level_bands(above: DataFrame) -> DataFrame:
    """low, high, area and volume of the bands between successive levels of ``above_levels``: the ground's share of them, and its volume between the two planes."""
    w = Window.orderBy("level")
    t = above.select("level", "area", "volume", *[F.lead(c).over(w).alias(f"{c}2") for c in ("level", "area", "volume")]).where("level2 is not null")
    return t.select(F.col("level").alias("low"), F.col("level2").alias("high"), (F.col("area") - F.col("area2")).alias("area"), (F.col("volume") - F.col("volume2")).alias("volume"))


def _along(w: WindowSpec, c: str, shift: int, wrap: bool) -> Column:
    """A column ``shift`` cells away; beyond an end, the other end's or the end's own."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.lead(c, shift) if shift > 0 else F.lag(c, -shift)
    end = (F.first(c) if (shift > 0) == wrap else F.last(c)).over(whole)
    return F.coalesce(step.over(w), end)


def binomial_smooth(cells: DataFrame, passes: int = 2) -> DataFrame:
    """Heights of a dense frame smoothed by 1, 2, 1 along both axes, ``passes`` times; nodata has no weight, and is filled where a neighbour is known. Ends meet the opposite ones."""
    now = cells.select("row", "col", F.col("z").cast("double").alias("z"))
    for _ in range(passes):
        now = now.select("row", "col", F.coalesce("z", F.lit(0.0)).alias("v"), F.col("z").isNotNull().cast("double").alias("w"))
        for axis in (along_col(), along_row()):
            mean = lambda c: ((_along(axis, c, 1, True) + 2 * F.col(c) + _along(axis, c, -1, True)) / 4).alias(c)  # noqa: B023, E731
            now = now.select("row", "col", mean("v"), mean("w"))
        now = now.select("row", "col", F.when(F.col("w") > 1e-9, F.col("v") / F.col("w")).alias("z"))
    return now


def gaussian_smooth(cells: DataFrame, sigma: float) -> DataFrame:
    """Heights of a dense frame smoothed by a gaussian of ``sigma`` cells, cut at three sigmas; nodata has no weight, and ends repeat."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k = k / k.sum()
    now = cells.select("row", "col", "z", F.coalesce(F.col("z").cast("double"), F.lit(0.0)).alias("v"), F.col("z").isNotNull().cast("double").alias("w"))
    for axis in (along_row(), along_col()):
        mean = lambda c: sum((float(k[i + r]) * (_along(axis, c, i, False) if i else F.col(c)) for i in range(-r, r + 1)), F.lit(0.0)).alias(c)  # noqa: B023, E731
        now = now.select("row", "col", "z", mean("v"), mean("w"))
    return now.select("row", "col", F.when(F.col("w") > 1e-6, F.col("v") / F.col("w")).otherwise(F.col("z")).alias("z"))


def drop_per_cell(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """row, col, z and drop: how far the ground falls over one cell, by central differences, one-sided at the frame's edge."""
    return gradient(cells, ny, nx, 1.0).select("row", "col", F.col("magnitude").alias("drop")).join(cells.select("row", "col", "z"), ["row", "col"])


def flat_levels(cells: DataFrame, ny: int, nx: int, levels: list[float], interval: float, share: float = 0.01) -> DataFrame:
    """level, n_flat and share_valid: contours on flat ground, cells that drop less than ``share`` of the interval and lie as close to the level; the most first."""
    limit = share * interval
    total = cells.agg(F.count("z")).first()[0] or 1
    flat = drop_per_cell(cells, ny, nx).where(F.col("drop") < limit)
    near = flat.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).where(F.abs(F.col("z") - F.col("level")) <= limit)
    return near.groupBy("level").agg(F.count("*").alias("n_flat")).withColumn("share_valid", F.col("n_flat") / total).orderBy(F.desc("n_flat"), "level")


def dilated(mask: DataFrame, ny: int, nx: int, times: int = 1) -> DataFrame:
    """row and col of a mask (row, col) with all cells within ``times`` steps of it, diagonals too."""
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.col(c) - times), F.least(F.lit(n - 1), F.col(c) + times))
    rows = mask.select(F.explode(span("row", ny)).alias("row"), span("col", nx).alias("cols"))
    return rows.select("row", F.explode("cols").alias("col")).distinct()


def _labelled(inside: np.ndarray) -> np.ndarray:
    """For each cell of a tile the number of the first cell, in row order, that hangs together with it; diagonals count."""
    ny, nx = inside.shape
    label = np.where(inside, np.arange(ny * nx).reshape(ny, nx), ny * nx)
    while True:
        wide = np.pad(label, 1, constant_values=ny * nx)
        near = np.min([wide[1 + i : 1 + i + ny, 1 + j : 1 + j + nx] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(inside, near, ny * nx)
        new = np.where(inside, np.append(new.ravel(), ny * nx)[new], ny * nx)
        if (new == label).all():
            return label
        label = new


def patches(mask: DataFrame, ny: int, nx: int, tile: int = 256) -> DataFrame:
    """row, col and patch (its first cell in row order) of the parts of a mask (row, col) that hang together, diagonals too.

    Tiles label their own cells; only cells on tiles' borders are joined with those beyond, and labels that meet there settle among themselves.
    """
    laid = mask.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()

    def label(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["row"].to_numpy() - key[0] * tile, frame["col"].to_numpy() - key[1] * tile
        inside = np.zeros((tile, tile), bool)
        inside[r, c] = True
        first = _labelled(inside)[r, c]
        return frame[["row", "col"]].assign(label=(first // tile + key[0] * tile).astype(np.int64) * nx + first % tile + key[1] * tile)

    n = max(mask.sparkSession.sparkContext.defaultParallelism, -(-ny * nx // tile**2))  # cells take few bytes but much memory to sort
    own = checkpointed(tiles(laid, tile, 0).repartition(n, "tr", "tc").groupBy("tr", "tc").applyInPandas(label, "row int, col int, label long"))
    rim = own.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    around = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc])).alias("p")
    met = rim.select(F.col("label").alias("a"), around).select("a", "p.row", "p.col").join(rim.withColumnRenamed("label", "b"), ["row", "col"]).where("a <> b").select("a", "b").distinct()
    roots = least_reached(met)
    return own.join(roots.select(F.col("node").alias("label"), "least"), "label", "left").select("row", "col", F.coalesce("least", "label").alias("patch"))


def bridges_removed(cells: DataFrame, mask: DataFrame, ny: int, nx: int, stretch: float = 2.0, quantile: float = 25.0) -> DataFrame:
    """Heights with the cells of a mask (row, col) lowered to what lies around them; each patch of the mask, with the ring of cells about it, is settled in one task, some ``_LOT`` masked cells in each.

    From a masked cell the nearest known cells are looked up both ways along the row, the column and both diagonals; a
    pair gives the height between them by distance. The lowest of the shortest spans counts, and of those up to ``stretch``
    times as long whose two ends lie in the lower ``quantile`` percent of the ring. No cell is raised; a cell without a span stays.
    """
    known = cells.where("z is not null").select("row", "col", "z")
    # Never a broadcast: rows of few compressed bytes are more than a driver holds.
    found = checkpointed(patches(mask.join(known.select("row", "col").hint("merge"), ["row", "col"], "left_semi"), ny, nx))
    span = lambda c: F.sequence(F.col(c) - 1, F.col(c) + 1)
    ring = found.select("patch", F.explode(span("row")).alias("row"), span("col").alias("cols")).select("patch", "row", F.explode("cols").alias("col")).distinct()
    own = found.select("patch", "row", "col", F.lit(True).alias("own"))
    laid = ring.join(own.hint("merge"), ["patch", "row", "col"], "left").join(known.hint("merge"), ["row", "col"])

    def lowered(frame: pd.DataFrame) -> list[tuple]:
        unknown = frame["own"]
        r, c, z = (frame[k] for k in ("row", "col", "z"))
        low = _percentile(np.sort(z[~unknown]), quantile) if not unknown.all() else -math.inf
        height = dict(zip(zip(r.tolist(), c.tolist(), strict=True), z.tolist(), strict=True))
        hidden = set(zip(r[unknown].tolist(), c[unknown].tolist(), strict=True))
        out = []
        for i, j in hidden:
            spans = []
            for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
                a, m = i + di, 1
                b = j + dj
                while (a, b) in hidden:
                    a, b, m = a + di, b + dj, m + 1
                u = height.get((a, b))
                if u is None:
                    continue
                a, n = i - di, 1
                b = j - dj
                while (a, b) in hidden:
                    a, b, n = a - di, b - dj, n + 1
                v = height.get((a, b))
                if v is not None and math.isfinite(u) and math.isfinite(v):
                    spans.append(((m + n) * math.hypot(di, dj), u + (v - u) * m / (m + n), u <= low and v <= low))
            if spans:
                short = min(s for s, _, _ in spans)
                best = min(v for s, v, deep in spans if s <= short * (1 + 1e-9) or (deep and s <= short * stretch + 1e-9))
                out.append((i, j, min(best, height[i, j])))
        return out

    def batch(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["patch"].to_numpy(), kind="stable")
        columns = {"row": frame["row"].to_numpy()[order], "col": frame["col"].to_numpy()[order], "z": frame["z"].to_numpy(float)[order], "own": frame["own"].notna().to_numpy()[order]}
        patch = frame["patch"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, patch[1:] != patch[:-1]])
        out = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(patch)], strict=True):
            out += lowered({k: v[start:end] for k, v in columns.items()})
        return pd.DataFrame(out, columns=["row", "col", "new"])

    # Patches are many and mostly small: some of them are a group together, as a group of its own for each costs more than its work.
    lots = max(mask.sparkSession.sparkContext.defaultParallelism, -(-found.count() // _LOT))
    lot = F.pmod(F.xxhash64("patch"), F.lit(lots)).alias("lot")
    new = laid.select("*", lot).repartition(lots, "lot").groupBy("lot").applyInPandas(lambda f: batch(f), "row int, col int, new double")
    return cells.join(new.hint("merge"), ["row", "col"], "left").select("row", "col", F.coalesce("new", "z").alias("z"))


def _percentile(ordered: np.ndarray, q: float) -> float:
    """Of sorted values, linear between ranks, as NumPy has it but without its cost for a few values."""
    at = (len(ordered) - 1) * (q / 100)
    k = min(math.floor(at), len(ordered) - 1)
    a, b, share = float(ordered[k]), float(ordered[min(k + 1, len(ordered) - 1)]), at - k
    if math.isnan(ordered[-1]):
        return math.nan
    return a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)


def height_shift(fine: DataFrame, coarse: DataFrame, plane: bool = False) -> dict[str, float]:
    """What to add to a coarse surface to meet a fine one: the median difference, or a plane (per column, per row, constant) fitted to the middle nine tenths of them."""
    d = fine.select("row", "col", F.col("z").alias("a")).join(coarse.select("row", "col", F.col("z").alias("b")), ["row", "col"]).select("row", "col", (F.col("a") - F.col("b")).alias("d")).where("d is not null")
    low, middle, high = quantiles(d, "d", [0.05, 0.5, 0.95])
    if middle is None:
        return {"x": 0.0, "y": 0.0, "c": 0.0}
    if not plane:
        return {"x": 0.0, "y": 0.0, "c": middle}
    x, y, v = F.col("col").cast("double"), F.col("row").cast("double"), F.col("d")
    terms = [x, y, F.lit(1.0)]
    kept = d.where(v.between(low, high))
    s = kept.agg(*[F.sum(a * b).alias(f"a{i}{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)], *[F.sum(a * v).alias(f"b{i}") for i, a in enumerate(terms)]).first()
    found = np.linalg.lstsq(np.array([[s[f"a{i}{j}"] for j in range(3)] for i in range(3)], float), np.array([s[f"b{i}"] for i in range(3)], float), rcond=None)[0]
    return dict(zip("xyc", map(float, found), strict=True))


def distance_to(mask: DataFrame, cells: DataFrame, width: float) -> DataFrame:
    """row, col and distance in cells of the ``cells`` (row, col) within ``width`` of a mask (row, col); 0 on it. A join on bins of the width, with the mask's edge only."""
    inner = [mask.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(1).alias("k")) for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    near = inner[0].union(inner[1]).union(inner[2]).union(inner[3]).groupBy("row", "col").agg(F.count("*").alias("k"))
    edge = mask.join(near.where("k = 4").select("row", "col"), ["row", "col"], "left_anti")
    at = lambda t: t.select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    outside = cells.select("row", "col").join(mask, ["row", "col"], "left_anti")
    found = near_join(at(outside), at(edge), width).groupBy(F.col("l_row").alias("row"), F.col("l_col").alias("col")).agg(F.min("h").alias("distance"))
    return found.union(mask.join(cells.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", F.lit(0.0)))


def grafted(fine: DataFrame, coarse: DataFrame, mask: DataFrame, width: float, plane: bool = False) -> DataFrame:
    """row, col and z: a detailed surface inside a mask (row, col), a regional one beyond ``width`` cells, and a smooth passage between.

    The regional surface is first shifted to the detailed one, by their median difference (or plane) in the ring around the mask where both
    are known. The detailed one's weight falls as 1 - t^2 (3 - 2t) over the ring; where one of them lacks, the other stands.
    """
    both = fine.select("row", "col", F.col("z").alias("a")).join(coarse.select("row", "col", F.col("z").alias("b")), ["row", "col"], "full")
    away = distance_to(mask, both, width)
    ring = away.where("distance > 0").select("row", "col")
    shift = height_shift(fine.join(ring, ["row", "col"], "left_semi"), coarse.join(ring, ["row", "col"], "left_semi"), plane)
    moved = F.col("b") + shift["x"] * F.col("col") + shift["y"] * F.col("row") + shift["c"]
    t = F.least(F.coalesce(F.col("distance"), F.lit(width)) / width, F.lit(1.0))
    w = 1 - t * t * (3 - 2 * t)
    got = both.join(away, ["row", "col"], "left")
    return got.select("row", "col", F.coalesce(w * F.col("a") + (1 - w) * moved, "a", moved).alias("z"))
