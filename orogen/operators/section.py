"""Sections, profiles and river cross-sections: vertices (line, seq, x, y), stations along them, water levels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.functions.scalar import CURVATURE, TILT, manning, reduction


def segments(vertices: DataFrame) -> DataFrame:
    """line, seq, both ends, length, azimuth and ``d0``, the way along the line to the segment's start."""
    w = Window.partitionBy("line").orderBy("seq")
    s = vertices.select("line", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    s = s.withColumn("length", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)).withColumn("azimuth", F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(360.0)))
    return s.withColumn("d0", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def stations(vertices: DataFrame, step: float) -> DataFrame:
    """line, d, x, y every ``step`` along each line; a station at a corner belongs to the segment it starts."""
    s = segments(vertices)
    first = F.ceil(F.col("d0") / step)
    last = F.ceil((F.col("d0") + F.col("length")) / step) - 1
    s = s.where(last >= first).withColumn("k", F.explode(F.sequence(first, last))).withColumn("d", F.col("k") * float(step))
    t = (F.col("d") - F.col("d0")) / F.col("length")
    return s.select("line", "d", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def nearest_segments(points: DataFrame, segs: DataFrame, told: Callable[[Column], Column]) -> DataFrame:
    """id, line and ``b``, the least of what ``told`` makes of a point (id, line, px, py) and each segment of its line: a struct that begins with their distance.

    Segments fall into the squares of a lattice that they pass, about eight of them each, and a point meets the segments of the nine squares around it.
    What is found within a square's side is the nearest; other points go on with squares four times as large, until they cover everything.
    A point without a place meets the first segment of its line.
    """
    segs = checkpointed(segs.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null"))
    ends = F.struct("seq", "x0", "y0", "x1", "y1", "length", "d0")
    sound = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in ("px", "py")]
    points = points.withColumn("sound", sound[0] & sound[1])
    first = segs.groupBy("line").agg(F.min(ends).alias("g"))
    parts = [points.where("not sound").join(first, "line").groupBy("id", "line").agg(F.min(told(F.col("g"))).alias("b"))]
    left = checkpointed(points.where("sound").join(first.select("line"), "line", "left_semi").select("id", "line", "px", "py"))
    way = F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))
    box = lambda t, x, y: t.agg(*[f(F.col(c)).alias(f"{n}{k}") for k, cs in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max)) for c in cs])
    size = segs.agg(F.count("*").alias("n"), F.sum(way).alias("way")).first()
    boxes = [box(left, ["px"], ["py"]).first(), box(segs, ["x0"], ["y0"]).first(), box(segs, ["x1"], ["y1"]).first()]
    if not size["n"] or boxes[0]["lox"] is None:
        return parts[0]
    span = max(max(b[f"hi{k}"] for b in boxes) - min(b[f"lo{k}"] for b in boxes) for k in "xy")
    side = max(size["way"] / (8 * size["n"]), span / 2**20) or 1.0
    while True:
        at = lambda c: F.floor(c / side)  # noqa: B023, E731
        # Along x square by square, and in each from the lower to the upper of the heights at which the segment crosses it.
        x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
        laid = segs.withColumn("sx", F.explode(F.sequence(at(F.least(x0, x1)), at(F.greatest(x0, x1)))))
        height = lambda x: y0 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)))) * (y1 - y0)  # noqa: B023, E731
        a = F.when(x0 == x1, y0).otherwise(height(F.col("sx") * side))
        b = F.when(x0 == x1, y1).otherwise(height((F.col("sx") + 1) * side))
        slack = 1e-9 * (side + F.abs(a) + F.abs(b))
        laid = laid.withColumn("sy", F.explode(F.sequence(at(F.least(a, b) - slack), at(F.greatest(a, b) + slack))))
        squares = laid.groupBy("line", "sx", "sy").agg(F.collect_list(ends).alias("segs"))
        around = F.explode(F.array(*[F.struct((at(F.col("px")) + i).alias("sx"), (at(F.col("py")) + j).alias("sy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        met = left.withColumn("k", around).select("id", "line", "px", "py", "k.sx", "k.sy").join(squares, ["line", "sx", "sy"])
        met = met.select("id", "line", F.array_min(F.transform("segs", told)).alias("b"))
        got = checkpointed(met.groupBy("id", "line").agg(F.min("b").alias("b")))
        if side >= span:
            parts.append(got)
            break
        near = got.where(F.col("b").getField(got.schema["b"].dataType.names[0]) <= side * (1 - 1e-6))
        parts.append(near)
        seen = near.select(F.col("id").alias("_id"), F.col("line").alias("_line"))
        left = checkpointed(left.join(seen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("line") == F.col("_line")), "left_anti"))
        if left.isEmpty():
            break
        side = min(4 * side, span)
    return fold(DataFrame.union, parts)


def project(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, line, d (way along), offset (distance) of each point (id, line, x, y) at its line's nearest place; the first of equals."""

    def told(g: Column) -> Column:
        along = (F.col("px") - g["x0"]) * (g["x1"] - g["x0"]) + (F.col("py") - g["y0"]) * (g["y1"] - g["y0"])
        t = F.when(g["length"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(along, g["length"] ** 2)))).otherwise(0.0)
        dx = F.col("px") - g["x0"] - t * (g["x1"] - g["x0"])
        dy = F.col("py") - g["y0"] - t * (g["y1"] - g["y0"])
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("offset"), g["seq"].alias("seq"), (g["d0"] + t * g["length"]).alias("d"))

    p = points.select("id", "line", F.col("x").alias("px"), F.col("y").alias("py"))
    return nearest_segments(p, segments(vertices), told).select("id", "line", "b.d", "b.offset")


def wetted(profiles: DataFrame, levels: DataFrame) -> DataFrame:
    """area, width and perimeter under each level of each profile (sec, seq, d, z); a node at the level is dry.

    Each segment's part under water counts exactly: trapezoids, and triangles where it leaves the water.
    """
    w = Window.partitionBy("sec").orderBy("seq")
    s = profiles.select("sec", F.col("d").alias("d0"), F.col("z").alias("z0"), F.lead("d").over(w).alias("d1"), F.lead("z").over(w).alias("z1")).where("d1 is not null").join(levels, "sec")
    s = s.withColumn("h0", F.col("level") - F.col("z0")).withColumn("h1", F.col("level") - F.col("z1")).where("h0 > 0 or h1 > 0")
    both, t = (F.col("h0") > 0) & (F.col("h1") > 0), F.try_divide(F.col("h0"), F.col("h0") - F.col("h1"))
    part = F.when(both, 1.0).when(F.col("h0") > 0, t).otherwise(1 - t)
    s = s.withColumn("part", part).withColumn("dd", part * (F.col("d1") - F.col("d0")))
    depth = F.when(both, F.col("h0") + F.col("h1")).otherwise(F.greatest("h0", "h1"))
    return s.groupBy("sec", "level").agg(
        F.sum(0.5 * depth * F.col("dd")).alias("area"), F.sum("dd").alias("width"),
        F.sum(F.sqrt(F.col("dd") ** 2 + (F.col("part") * (F.col("z1") - F.col("z0"))) ** 2)).alias("perimeter"),
    )


def rating(profiles: DataFrame, levels: DataFrame, roughness: float, slope: float) -> DataFrame:
    """sec, level, area, width, perimeter, discharge and mean velocity."""
    q = manning(F.col("area"), F.col("perimeter"), F.lit(roughness), F.lit(slope))
    return wetted(profiles, levels).withColumn("q", q).withColumn("velocity", F.when(F.col("area") > 0, F.try_divide(F.col("q"), F.col("area"))).otherwise(0.0))


def level_for(curve: DataFrame, flows: DataFrame) -> DataFrame:
    """The level at which each flow (sec, flow) passes, between the curve's levels; the first crossing, null outside the curve."""
    w = Window.partitionBy("sec").orderBy("level")
    s = curve.select("sec", "level", "q", F.lead("level").over(w).alias("level1"), F.lead("q").over(w).alias("q1"))
    hit = flows.join(s, "sec").where((F.col("flow") >= F.col("q")) & (F.col("flow") <= F.col("q1")))
    at = F.col("level") + F.coalesce(F.try_divide(F.col("flow") - F.col("q"), F.col("q1") - F.col("q")), F.lit(0.0)) * (F.col("level1") - F.col("level"))
    got = hit.groupBy("sec", "flow").agg(F.min_by(at, "level").alias("level"))
    return flows.join(got, ["sec", "flow"], "left")


def deformations(profiles: DataFrame, reduce: bool = True) -> DataFrame:
    """Tilt of each interval and curvature at its start, of settlements (profile, d, settle) along profiles.

    With ``reduce`` they are brought to intervals of 15 m: tilts by their interval's length, curvatures, which
    are differences of reduced tilts, by the mean of the two lengths. The ends of a profile have no curvature.
    """
    w = Window.partitionBy("profile").orderBy("d")
    s = profiles.withColumn("len", F.lead("d").over(w) - F.col("d"))
    tilt = F.when(F.col("len") > 0, F.try_divide(F.lead("settle").over(w) - F.col("settle"), F.col("len")))
    s = s.withColumn("tilt", tilt * (reduction(F.col("len"), TILT) if reduce else 1.0))
    s = s.withColumn("mean", 0.5 * (F.col("len") + F.lag("len").over(w)))
    curvature = F.when(F.col("mean") > 0, F.try_divide(F.col("tilt") - F.lag("tilt").over(w), F.col("mean")))
    return s.withColumn("curvature", curvature * (reduction(F.col("mean"), CURVATURE) if reduce else 1.0)).drop("mean")


def _bed_findings(beds: DataFrame, zero: float, known: DataFrame | None) -> DataFrame:
    """Beds with thickness ``m``, ``gap`` to the next bed, and whether they are thin, negative, known to be, or crossing."""
    if known is not None:
        marked = known.select("row", "col").distinct().withColumn("known", F.lit(True))
        beds = beds.join(marked, ["row", "col"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    else:
        beds = beds.withColumn("known", F.lit(False))
    w = Window.partitionBy("row", "col").orderBy("rank")
    beds = beds.withColumn("m", F.col("top") - F.col("bottom")).withColumn("gap", F.col("bottom") - F.lead("top").over(w))
    negative = F.coalesce(F.col("m") < -abs(zero), F.lit(False))
    return beds.select(
        "row", "col", "rank", "m", "gap", "known",
        F.coalesce(F.abs("m") <= zero, F.lit(False)).alias("thin"), negative.alias("negative"),
        F.coalesce(F.col("gap") < -abs(zero), F.lit(False)).alias("crossing"),
    )


def stack_codes(beds: DataFrame, zero: float = 0.0, known: DataFrame | None = None) -> DataFrame:
    """Of bed stacks (row, col, rank, top, bottom; from the top down): each cell's worst finding, and the least gap between neighbours.

    4 a negative thickness where ``known`` cells (row, col) tell that the stack is overturned, 3 the
    bottom of a bed lies more than ``zero`` below the next bed's top (not in known cells), 2 a
    negative thickness, 1 a thickness within ``zero`` of none, 0 none of these; the highest wins. Missing surfaces find nothing.
    """
    f = _bed_findings(beds, zero, known)
    code = F.greatest(
        F.when(F.col("negative") & F.col("known"), 4).otherwise(0), F.when(F.col("crossing") & ~F.col("known"), 3).otherwise(0),
        F.when(F.col("negative"), 2).otherwise(0), F.when(F.col("thin"), 1).otherwise(0),
    )
    return f.groupBy("row", "col").agg(F.max(code).alias("code"), F.min("gap").alias("least_gap"))


def stack_report(beds: DataFrame, zero: float = 0.0, known: DataFrame | None = None) -> DataFrame:
    """For each bed (rank): cells with a thickness, thin, negative and known ones, extremes of thickness, and crossings of and the least gap to the next bed."""
    f = _bed_findings(beds, zero, known)
    return f.groupBy("rank").agg(
        F.count("m").alias("n_valid"), F.count_if("thin").alias("n_zero"), F.count_if(F.col("negative") & ~F.col("known")).alias("n_neg"),
        F.count_if(F.col("negative") & F.col("known")).alias("n_known"), F.min("m").alias("least"), F.max("m").alias("most"),
        F.count("gap").alias("n_contact"), F.count_if(F.col("crossing") & ~F.col("known")).alias("n_cross"), F.min("gap").alias("least_gap"),
    )
