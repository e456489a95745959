"""Surfaces of terrain: through points, parted by cliffs, with streams that fall all the way and lakes that are level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.operators.burning import along, outlined
from orogen.operators.curvature import minimum_curvature, snapped


def stream_beds(passed: DataFrame, ground: DataFrame, anchors: DataFrame, drop: float, rounds: int = 100) -> DataFrame:
    """line, k, row, col and bed of the cells (line, k, row, col) that streams pass, k growing downstream.

    A bed begins as the ground (row, col, z) and falls by ``drop`` a cell at least. Anchors (row, col, pin) on a stream are kept: below
    one the bed lies under it by the fall of the cells between, above one over it. Where two anchors rise downstream the upper one gives way. Streams that share a
    cell have one bed there, the lowest; a stream below another's bed draws it down from there on, so it goes on until no bed changes, in as many rounds as
    streams run into one another. Streams that run in a circle have no such beds: that raises.
    """
    w = Window.partitionBy("line").orderBy("k")
    down, up = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    fall = drop * F.col("k")
    laid = passed.join(ground.where("z is not null").select("row", "col", "z"), ["row", "col"]).join(anchors.select("row", "col", "pin"), ["row", "col"], "left")
    # Heights are taken as over a bed that falls by the least drop: then caps are running minima, floors running maxima.
    level = laid.select("line", "k", "row", "col", (F.col("z") + fall).alias("z"), (F.col("pin") + fall).alias("pin"))
    level = level.withColumn("pin", F.when(F.col("pin").isNotNull(), F.min("pin").over(down)))
    cap, floor = F.min("pin").over(down), F.max("pin").over(up)
    free = F.min(F.least(F.greatest("z", F.coalesce(floor, F.col("z"))), F.coalesce(cap, F.col("z")))).over(down)
    now = checkpointed(level.select("line", "k", "row", "col", free.alias("bed"), F.lit(True).alias("moved")).select("line", "k", "row", "col", (F.col("bed") - fall).alias("bed"), "moved"))
    for _ in range(rounds):
        least = now.groupBy("row", "col").agg(F.min("bed").alias("least"))
        drawn = now.join(least, ["row", "col"]).select("line", "k", "row", "col", "bed", (F.min(F.col("least") + fall).over(down) - fall).alias("new"))
        now = checkpointed(drawn.select("line", "k", "row", "col", F.least("bed", "new").alias("bed"), (F.col("new") < F.col("bed") - 1e-9).alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
    raise RuntimeError(f"stream beds did not settle in {rounds} rounds: do streams run in a circle?")


def surface(
    points: DataFrame, x0: float, y0: float, cell: float, ny: int, nx: int, streams: DataFrame | None = None, lakes: DataFrame | None = None, cliffs: DataFrame | None = None,
    drop: float = 0.01, tension: float = 0.5, tol: float = 1e-3, tile: int = 64,
) -> DataFrame:
    """row, col, z and kind (point, stream, lake or null) of terrain through points (x, y, v), row 0 north.

    First the surface is laid through the points alone, not across cliffs (segments x0, y0, x1, y1). On it lakes (rings: line, seq, x, y, level) get
    their level, the given one or the lowest of the ground inside and along them; streams (line, seq, x, y, downstream) get beds that fall all the way
    (``stream_beds``), past points and lakes on them. Then the surface is laid once more through points, lakes and beds, so no cell
    of a stream is a pit. In a cell a lake counts before a stream, a stream before points. Both surfaces are solved tile by tile, coarse to fine.
    """
    lay = lambda p: minimum_curvature(p, x0, y0, cell, ny, nx, cliffs, tension=tension, edge_tension=tension, tol=tol, tile=tile)
    top = y0 + ny * cell
    pins = checkpointed(snapped(points, x0, y0, cell, ny, nx))
    held = pins.select("row", "col", F.col("pin").alias("z"), F.lit("point").alias("kind"), F.lit(2).alias("rank"))
    if streams is not None or lakes is not None:
        ground = lay(points)
        anchors = pins
        if lakes is not None:
            inside = outlined(lakes, x0, top, cell, ny, nx)
            given = lakes.groupBy("line").agg(F.max("level").alias("level"))
            levels = inside.join(ground, ["row", "col"]).groupBy("line").agg(F.min("z").alias("low")).join(given, "line").select("line", F.coalesce("level", "low").alias("z"))
            water = checkpointed(inside.join(levels, "line").groupBy("row", "col").agg(F.min("z").alias("z")))
            held = held.union(water.select("row", "col", "z", F.lit("lake"), F.lit(0)))
            anchors = pins.join(water, ["row", "col"], "left_anti").select("row", "col", "pin").union(water)
        if streams is not None:
            beds = stream_beds(along(streams, x0, top, cell, ny, nx), ground, anchors, drop).groupBy("row", "col").agg(F.min("bed").alias("z"))
            held = held.union(beds.select("row", "col", "z", F.lit("stream"), F.lit(1)))
    first = held.groupBy("row", "col").agg(F.min_by(F.struct("z", "kind"), "rank").alias("h")).select("row", "col", "h.z", "h.kind")
    first = checkpointed(first)
    middles = first.select((x0 + (F.col("col") + 0.5) * cell).alias("x"), (top - (F.col("row") + 0.5) * cell).alias("y"), F.col("z").alias("v"))
    return lay(middles).join(first.select("row", "col", "kind"), ["row", "col"], "left")
