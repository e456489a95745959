"""Break lines of the ground: where the slope changes, as ridges of its gradient, thinned to lines and traced."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.functions.ranks import quantiles
from orogen.operators.lines import chained
from orogen.operators.raster import NEIGHBOURS, along_col, along_row, binomial_smooth, patches, slope_aspect, stencil, tiles, window_range

#: The least turn of a slope, in degrees a cell, that counts as a break.
LEAST_TURN = 5.0


def _grad(t: DataFrame, name: str, cell: float, ny: int, nx: int) -> tuple[Column, Column]:
    """Differences to the east and to the north of a column of a dense frame, central, at the frame's edges one-sided."""
    def along(w, k: str, n: int) -> Column:
        low, high, own = F.lag(name).over(w), F.lead(name).over(w), F.col(name)
        return F.when(F.col(k) == 0, (high - own) / cell).when(F.col(k) == n - 1, (own - low) / cell).otherwise((high - low) / (2 * cell))

    return along(along_row(), "col", nx), -along(along_col(), "row", ny)


def edge_strength(cells: DataFrame, ny: int, nx: int, cell: float) -> DataFrame:
    """row, col, e, sign and slope of a dense frame's cells.

    ``e`` is the gradient of the smoothed slope in degrees a metre, 0 where it isn't known and in a band of two cells along the frame. ``sign`` is 1 where the
    ground bends down along the slope (a crest), -1 where it bends up (a toe), else 0. ``slope`` is in degrees.
    """
    slope = slope_aspect(cells, ny, nx, cell).select("row", "col", "slope")
    smooth = binomial_smooth(slope.withColumnRenamed("slope", "z"), 2)
    sx, sy = _grad(smooth, "z", cell, ny, nx)
    inner = F.col("row").between(2, ny - 3) & F.col("col").between(2, nx - 3)
    strength = F.when(inner, F.coalesce(F.sqrt(sx * sx + sy * sy), F.lit(0.0))).otherwise(0.0)
    first = cells.select("row", "col", "z", *[c.alias(n) for c, n in zip(_grad(cells, "z", cell, ny, nx), ("zx", "zy"), strict=True)])
    (xx, _), (xy, yy) = _grad(first, "zx", cell, ny, nx), _grad(first, "zy", cell, ny, nx)
    second = first.select("row", "col", "zx", "zy", xx.alias("xx"), xy.alias("xy"), yy.alias("yy"))
    x, y = F.col("zx"), F.col("zy")
    bend = F.when(x * x + y * y > 1e-12, -(x * x * F.col("xx") + 2 * x * y * F.col("xy") + y * y * F.col("yy")) / (x * x + y * y))
    bent = binomial_smooth(second.select("row", "col", F.coalesce(bend, F.lit(0.0)).alias("z")), 1)
    sign = F.when(F.col("z") > 1e-9, 1).when(F.col("z") < -1e-9, -1).otherwise(0)
    return smooth.select("row", "col", strength.alias("e")).join(bent.select("row", "col", sign.alias("sign")), ["row", "col"]).join(slope, ["row", "col"])


def ridges(strength: DataFrame, ny: int, nx: int, cell: float) -> DataFrame:
    """row, col and e of the cells that are no weaker than their two neighbours across the ridge, along the gradient's nearest axis."""
    e = strength.select("row", "col", F.col("e").alias("z"))
    gx, gy = _grad(e, "z", cell, ny, nx)
    around = stencil(e.select("row", "col", "z"), ny, nx).join(e.select("row", "col", F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0)).alias("angle")), ["row", "col"])
    top = lambda *sides: F.greatest(*[F.coalesce(F.col(s), F.lit(0.0)) for s in sides]) <= F.col("z")
    a = F.col("angle")
    peak = F.when((a < 22.5) | (a >= 157.5), top("e", "w")).when(a < 67.5, top("ne", "sw")).when(a < 112.5, top("n", "s")).otherwise(top("nw", "se"))
    return around.where((F.col("z") > 0) & peak).select("row", "col", F.col("z").alias("e"))


def thresholds(found: DataFrame, cell: float) -> tuple[float, float]:
    """Low and high threshold of ridges: the lower quartile of their strength, no less than the least turn, and half of it."""
    quarter = quantiles(found, "e", [0.25])[0]
    if quarter is None:
        return 0.0, 0.0
    high = max(quarter, LEAST_TURN / cell)
    return high / 2, high


def hysteresis(weak: DataFrame, strong: DataFrame, ny: int, nx: int) -> DataFrame:
    """row and col of the weak cells that hang together with a strong one (both row, col; strong cells count as weak)."""
    every = weak.select("row", "col").union(strong.select("row", "col"))
    labelled = checkpointed(patches(every, ny, nx))
    seeds = labelled.join(strong.select("row", "col").distinct(), ["row", "col"]).select("patch").distinct()
    return labelled.join(seeds, "patch", "left_semi").select("row", "col")


#: Passes of a thinning round: two that peel (Zhang and Suen's sides), and one for each quarter of the cells that straightens steps.
_PASSES = 6


def _peeled(m: np.ndarray, k: int, r0: int, c0: int) -> np.ndarray:
    """The mask after pass ``k``; ``r0`` and ``c0`` place it in the frame, as quarters are the frame's."""
    p = np.pad(m, 1).astype(np.int8)
    n, ne, e, se, s, sw, w, nw = p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]
    ring = np.stack((n, ne, e, se, s, sw, w, nw))
    count = ring.sum(0)
    if k < 2:
        starts = ((ring == 0) & (np.roll(ring, -1, 0) == 1)).sum(0)
        open_sides = (n * e * s == 0) & (e * s * w == 0) if k == 0 else (n * e * w == 0) & (n * s * w == 0)
        gone = (count >= 2) & (count <= 6) & (starts == 1) & open_sides
    else:
        off = 1 - ring
        parts = sum(off[i] - off[i] * off[i - 1] * off[i - 2] for i in (0, 2, 4, 6))  # parts the neighbours fall into without the cell
        rows, cols = np.indices(m.shape)
        gone = (count >= 2) & (parts == 1) & ((rows + r0) % 2 * 2 + (cols + c0) % 2 == k - 2)
    return m & ~gone


def thinned(mask: DataFrame, tile: int = 256, turns: int = 4, rounds: int = 1000) -> DataFrame:
    """row and col of a mask (row, col) thinned to lines one cell wide, whose parts and ends stay.

    Passes alternate for all cells alike, each looking one cell around. A task runs ``turns`` rounds of passes on a tile with
    as many cells around it as that takes, so tiles don't show; it goes on until a turn changes nothing.
    """
    halo = turns * _PASSES
    now = checkpointed(mask.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct())
    n = now.count()

    def peel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        at = (frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0)
        m = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        m[at] = True
        for k in range(turns * _PASSES):
            m = _peeled(m, k % _PASSES, r0, c0)
        rows, cols = np.nonzero(m[halo : halo + tile, halo : halo + tile])
        return pd.DataFrame({"row": (rows + key[0] * tile).astype(np.int32), "col": (cols + key[1] * tile).astype(np.int32)})

    for _ in range(rounds):
        now = checkpointed(tiles(now, tile, halo).groupBy("tr", "tc").applyInPandas(peel, "row int, col int"))
        n, before = now.count(), n
        if n == before:
            return now
    raise RuntimeError(f"not thin after {rounds} rounds")


def _partners() -> list[tuple[int, int, int]]:
    """(ways that leave a cell as bits, way, way that goes on): ways are paired where they are opposite, then where they turn by half a right angle."""
    out = []
    for bits in range(256):
        left = [k for k in range(8) if bits >> k & 1]
        for turn in (4, 3, 5):
            for k in list(left):
                other = (k + turn) % 8
                if k in left and other in left:
                    out += [(bits, k, other), (bits, other, k)]
                    left = [x for x in left if x not in (k, other)]
    return out


def traced(skeleton: DataFrame, nx: int, tile: int = 256) -> DataFrame:
    """line, seq, row, col and closed of the lines along a one-cell skeleton (row, col).

    At each cell ways in and out are paired by the least turn, under a right angle; what isn't paired ends there. Every step between two neighbours
    lies on one line. Lines are chains of directed steps; of a line's two directions the one of the lesser name stays. Tiles follow
    their own steps first, so rounds are over the stretches between tiles.
    """
    spark = skeleton.sparkSession
    at = skeleton.select("row", "col").distinct().withColumn("cell", (F.col("row").cast("long") * nx + F.col("col")))
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for k, (_, dr, dc) in enumerate(NEIGHBOURS)])).alias("w")
    steps = checkpointed(at.select("cell", ways).select("cell", "w.*").join(at.select("row", "col", F.col("cell").alias("to")), ["row", "col"]).select("cell", "k", "to"))
    masks = steps.groupBy("cell").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("bits"))
    partner = F.broadcast(spark.createDataFrame(_partners(), "bits int, back int, go int"))  # fixed, some 1,500 rows
    into = steps.select((F.col("cell") * 8 + F.col("k")).alias("id"), F.col("to").alias("cell"), ((F.col("k") + 4) % 8).alias("back")).join(masks, "cell")
    place = F.expr(f"(id div 8 div {nx} div {tile}) * {1 << 24} + id div 8 % {nx} div {tile}").alias("tile")
    follow = into.join(partner, ["bits", "back"], "left").select("id", (F.col("cell") * 8 + F.col("go")).alias("next"), place)
    lines = checkpointed(chained(follow).join(steps.select((F.col("cell") * 8 + F.col("k")).alias("id"), "cell", "to", (F.col("to") * 8 + (F.col("k") + 4) % 8).alias("reverse")), "id"))
    other = lines.where("seq = 0").select("line", F.col("reverse").alias("id")).join(lines.select("id", F.col("line").alias("mirror")), "id")
    kept = lines.join(other.where("line < mirror").select("line"), "line")
    ends = kept.groupBy("line").agg(F.max_by("to", "seq").alias("cell"), (F.max("seq") + 1).alias("seq"), F.min_by("cell", "seq").alias("start"))
    every = kept.select("line", "seq", "cell").union(ends.select("line", "seq", "cell")).join(ends.select("line", (F.col("start") == F.col("cell")).alias("closed")), "line")
    return every.select("line", "seq", F.expr(f"cast(cell div {nx} as int)").alias("row"), (F.col("cell") % nx).cast("int").alias("col"), "closed")


def line_attributes(lines: DataFrame, cells: DataFrame, strength: DataFrame, cell: float, probe: int = 3) -> DataFrame:
    """line, n_cells, length, drop, slope and kind (brow, toe or flat) of traced lines.

    Heights and slopes are read ``probe`` cells to both sides, square to each vertex's neighbours; medians over the vertices count, of the sign too.
    """
    w = Window.partitionBy("line").orderBy("seq")
    near = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    laid = lines.select("line", "seq", "row", "col", (near(F.lead, "row") - near(F.lag, "row")).alias("dr"), (near(F.lead, "col") - near(F.lag, "col")).alias("dc"), F.lag("row").over(w).alias("r"), F.lag("col").over(w).alias("c"))
    size = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    laid = laid.withColumn("step", F.sqrt(F.pow(F.col("row") - F.col("r"), F.lit(2)) + F.pow(F.col("col") - F.col("c"), F.lit(2)))).withColumn("size", size)
    field = cells.select("row", "col", "z").join(strength.select("row", "col", "sign", "slope"), ["row", "col"])
    for side, way in (("a", 1), ("b", -1)):
        row, col = F.rint(F.col("row") - way * probe * F.col("dc") / F.col("size")).cast("int"), F.rint(F.col("col") + way * probe * F.col("dr") / F.col("size")).cast("int")
        laid = laid.withColumn(f"{side}r", F.when(F.col("size") > 0, row)).withColumn(f"{side}c", F.when(F.col("size") > 0, col))
        there = field.select(F.col("row").alias(f"{side}r"), F.col("col").alias(f"{side}c"), F.col("z").alias(f"{side}z"), F.col("slope").alias(f"{side}s"), F.lit(True).alias(f"{side}in"))
        laid = laid.join(there, [f"{side}r", f"{side}c"], "left")
    both = F.col("ain") & F.col("bin")
    laid = laid.join(field.select("row", "col", "sign"), ["row", "col"], "left")
    middle = lambda c: F.percentile(F.when(both, c), 0.5)
    sums = laid.groupBy("line").agg(F.count("*").alias("n_cells"), (F.coalesce(F.sum("step"), F.lit(0.0)) * cell).alias("length"), F.coalesce(middle(F.abs(F.col("az") - F.col("bz"))), F.lit(0.0)).alias("drop"), F.coalesce(middle((F.col("as") + F.col("bs")) / 2), F.lit(0.0)).alias("slope"), F.coalesce(middle(F.col("sign")), F.lit(0.0)).alias("s"))
    return sums.select("line", "n_cells", "length", "drop", "slope", F.when(F.col("s") > 0, "brow").when(F.col("s") < 0, "toe").otherwise("flat").alias("kind"))


def break_lines(cells: DataFrame, ny: int, nx: int, cell: float, least_drop: float = 0.2, least_cells: int = 5, probe: int = 3) -> tuple[DataFrame, DataFrame]:
    """Vertices (``traced``) and attributes (``line_attributes``) of the crests and toes of a dense frame, without lines that are short or drop little."""
    strength = checkpointed(edge_strength(cells, ny, nx, cell))
    relief = window_range(cells, probe).where(F.col("high") - F.col("low") >= least_drop).select("row", "col")
    found = checkpointed(ridges(strength, ny, nx, cell).join(relief, ["row", "col"], "left_semi"))
    low, high = thresholds(found, cell)
    kept = hysteresis(found.where(F.col("e") >= low), found.where(F.col("e") >= high), ny, nx)
    lines = checkpointed(traced(thinned(kept), nx))
    told = checkpointed(line_attributes(lines, cells, strength, cell, probe).where((F.col("n_cells") >= least_cells) & (F.col("drop") >= least_drop)))
    return lines.join(told.select("line"), "line", "left_semi"), told
