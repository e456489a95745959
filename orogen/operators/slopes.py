"""Heights along slope lines from contours and spot heights, and the pairing of crests with toes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.joins import near_join
from orogen.operators.burning import water_surface
from orogen.operators.lines import crossings, near_line
from orogen.operators.section import segments


def samples(lines: DataFrame, contours: DataFrame, tolerance: float, spots: DataFrame | None = None) -> DataFrame:
    """line, d and z of the places where lines (line, seq, x, y) meet contours (line, seq, x, y, z), and of spot heights (id, x, y, z) by them.

    A contour that doesn't cross a line meets it where one of its ends lies within ``tolerance``; a spot height does within ``tolerance``. Contours
    without a height are left out. All are found by bins.
    """
    known = contours.where("z is not null")
    met = crossings(lines, known, max(tolerance * 4, 1e-9)).select("line", "other", "d", "z")
    order = F.struct("x", "y", "z")
    ends = known.groupBy("line").agg(F.min_by(order, "seq").alias("a"), F.max_by(order, "seq").alias("b")).select(F.col("line").alias("other"), F.posexplode(F.array("a", "b")).alias("k", "p"))
    points = ends.select(F.struct("other", "k").alias("id"), "p.x", "p.y", "p.z")
    by = near_line(points.select("id", "x", "y"), lines, tolerance).join(points.select("id", "z"), "id").select("line", F.col("id.other").alias("other"), "d", "z")
    out = met.select("line", "d", "z").union(by.join(met.select("line", "other").distinct(), ["line", "other"], "left_anti").select("line", "d", "z"))
    if spots is not None:
        near = near_line(spots.where("z is not null").select("id", "x", "y"), lines, tolerance)
        out = out.union(near.join(spots.select("id", "z"), "id").select("line", "d", "z"))
    return out


def profiled(lines: DataFrame, found: DataFrame) -> DataFrame:
    """line, seq, x, y, z and n_samples of the vertices of lines (line, seq, x, y): heights linear between the samples (line, d, z) along the line.

    Samples at one place count with their mean. Beyond the outermost ones the height stays; a line whose last vertex is its first is closed, and
    heights go on across it. A line without samples keeps null heights.
    """
    s = segments(lines)
    ends = s.groupBy("line").agg(F.max(F.col("d0") + F.col("length")).alias("size"), F.max_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), "seq").alias("last"), F.min_by(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), "seq").alias("first"))
    ends = ends.select("line", "size", (F.col("last") == F.col("first")).alias("closed"))
    w = Window.partitionBy("line").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    laid = lines.select("line", "seq", "x", "y", F.coalesce(step, F.lit(0.0)).alias("step"))
    laid = laid.select("line", "seq", "x", "y", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    known = found.groupBy("line", F.round("d", 9).alias("d")).agg(F.avg("z").alias("z"))
    counts = known.groupBy("line").agg(F.count("*").alias("n_samples"))
    turns = F.when(F.col("closed"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    around = known.join(ends, "line").withColumn("turn", F.explode(turns)).select(F.col("line").alias("key"), (F.col("d") + F.col("turn") * F.col("size")).alias("s"), F.col("z").alias("level"))
    got = water_surface(laid.select(F.col("line").alias("key"), "s", "seq"), around).select(F.col("key").alias("line"), "seq", F.col("level").alias("z"))
    return laid.select("line", "seq", "x", "y").join(got, ["line", "seq"], "left").join(counts, "line", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def paired(crests: DataFrame, toes: DataFrame, reach: float) -> DataFrame:
    """line, kind, toe, distance and reason of crests and toes (both line, seq, x, y, z): each crest with the nearest toe that lies lower, by mean heights.

    Distances are between vertices, the nearest of equals is the toe of the lesser name, and none beyond ``reach`` counts. A crest without one says whether no
    toe lies lower or the nearest is too far; a toe that no crest belongs to is listed too. Vertices meet in bins of ``reach``.
    """
    mean = lambda t, n: t.groupBy("line").agg(F.avg("z").alias("z")).select(F.col("line").alias(n), F.col("z").alias(f"{n}_z"))
    high, low = mean(crests, "crest"), mean(toes, "toe")
    near = near_join(crests.select("line", "x", "y"), toes.select("line", "x", "y"), reach).groupBy(F.col("l_line").alias("crest"), F.col("r_line").alias("toe")).agg(F.min("h").alias("h"))
    lower = near.join(high, "crest").join(low, "toe").where(F.col("toe_z") < F.col("crest_z"))
    best = lower.groupBy("crest").agg(F.min(F.struct("h", "toe")).alias("b")).select("crest", "b.toe", "b.h")
    least = low.agg(F.min("toe_z").alias("least"))
    reason = F.when(F.col("toe").isNull(), F.when(F.col("least") < F.col("crest_z"), "too far").otherwise("none lower"))
    first = high.crossJoin(least).join(best, "crest", "left").select(F.col("crest").alias("line"), F.lit("brow").alias("kind"), "toe", F.col("h").alias("distance"), reason.alias("reason"))  # one row on the right
    unused = low.join(best.select("toe").distinct(), "toe", "left_anti").select(F.col("toe").alias("line"), F.lit("toe").alias("kind"), F.lit(None).cast(dict(toes.dtypes)["line"]).alias("toe"), F.lit(None).cast("double").alias("distance"), F.lit("no crest").alias("reason"))
    return first.union(unused)
