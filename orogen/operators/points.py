"""Scans, clips, weights and scores of point samples (id, x, y, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.ranks import quantiles
from orogen.functions.scalar import inverse_normal as quantile


def scan(samples: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Samples with a place and a value; those closer than ``tolerance`` of the larger span are averaged under the least id."""
    known = samples.where("x is not null and y is not null and v is not null")
    b = known.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    step = tolerance * max(b[0] or 0.0, b[1] or 0.0) or 1.0
    return known.groupBy(F.round(F.col("x") / step).alias("kx"), F.round(F.col("y") / step).alias("ky")).agg(F.min("id").alias("id"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("v").alias("v")).drop("kx", "ky")


def clip(samples: DataFrame, percent: float, low: float | None = None, high: float | None = None, cap: bool = False) -> DataFrame:
    """Drop or cap values outside the ``percent`` and ``100 - percent`` percentiles; given bounds override them."""
    if low is None or high is None:
        q = quantiles(samples, "v", [percent / 100, 1 - percent / 100])
        low, high = q[0] if low is None else low, q[1] if high is None else high
    low, high = min(low, high), max(low, high)
    if cap:
        return samples.withColumn("v", F.least(F.greatest("v", F.lit(low)), F.lit(high)))
    return samples.where(F.col("v").between(low, high))


def warnings(samples: DataFrame, least: int = 8) -> DataFrame:
    """Counts that tell whether samples can carry a variogram."""
    return samples.agg(
        F.count("*").alias("n"),
        F.count_distinct("x", "y").alias("n_places"),
        (F.count("*") < least).alias("too_few"),
        (F.min("v") == F.max("v")).alias("constant"),
        ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("on_a_line"),
    )


def decluster_sweep(samples: DataFrame, sizes: list[float], offsets: int = 4, aspect: float = 1.0) -> DataFrame:
    """size, id, weight: cell declustering weights for each cell size.

    A sample's weight is the mean over shifted grid origins of 1 / samples in its cell, scaled to sum
    to the number of samples. One pass does all sizes; cells are counted by partial sums.
    """
    b = samples.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count("*").alias("n")).first()
    size = F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("size")
    shift = F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("shift")
    laid = samples.select("id", "x", "y", size).select("*", shift)
    at = lambda c, low, k: F.floor((F.col(c) - (low - k * F.col("size") * (F.col("shift") + 0.5) / offsets)) / (k * F.col("size")))
    laid = laid.select("id", "size", "shift", at("x", b["x"], 1.0).alias("ix"), at("y", b["y"], aspect).alias("iy"))
    cells = ["size", "shift", "ix", "iy"]
    raw = laid.join(laid.groupBy(cells).agg(F.count("*").alias("k")).hint("merge"), cells).groupBy("size", "id").agg((F.sum(1 / F.col("k")) / offsets).alias("raw"))
    total = raw.groupBy("size").agg(F.sum("raw").alias("total"))
    return raw.join(total, "size").select("size", "id", (F.col("raw") * b["n"] / F.col("total")).alias("weight"))


def declustered_means(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """size and declustered mean for each cell size."""
    return weights.join(samples.select("id", "v"), "id").groupBy("size").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("mean"))


def normal_score(samples: DataFrame, buckets: int = 256, weight: str | None = None) -> DataFrame:
    """Samples with ``p``, the share (rank + 0.5) / n of values before theirs (ties by id), to be passed to the inverse normal.

    With a column ``weight``, the share of weight before theirs and half their own, kept off 0 and 1 by 1e-6.

    Values fall into ``buckets`` ranges of about equal counts; the ranges' totals go through the
    driver, ranks within a range come from a window, so no task ranks all samples.
    """
    edges = sorted(set(samples.approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    placed = samples.withColumn("bucket", bucket)
    own = F.col(weight) if weight else F.lit(1)
    totals = {r["bucket"]: r["total"] for r in placed.groupBy("bucket").agg(F.sum(own).alias("total")).collect()}
    n, before, start = sum(totals.values()), [], 0
    for k in sorted(totals):
        before += [F.lit(k), F.lit(start)]
        start += totals[k]
    within = F.sum(own).over(Window.partitionBy("bucket").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)) - own
    first = F.create_map(*before)[F.col("bucket")] if before else F.lit(0)
    p = (first + within + 0.5 * own) / n
    return placed.withColumn("p", F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) if weight else p).drop("bucket")


def inverse_normal(table: DataFrame, p: str, score: str) -> DataFrame:
    """``table`` with ``score``, the standard normal quantile of ``p``."""
    return table.withColumn(score, quantile(F.col(p).cast("double")))


def back_transform(table: DataFrame, score: str, scores: DataFrame) -> DataFrame:
    """``table`` with ``value``, its ``score`` interpolated in ``scores`` (v, score) and held to the range of ``v``.

    Steps between successive scores are joined by bins of the score; a bin's last step ends at
    the first score of the next bin, so only the bins' firsts are ordered in one task.
    """
    known = scores.select("v", F.col("score").alias("s"))
    b = known.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).first()
    fine = float(min(100_000, max(100, b["n"] // 100)))
    bin_of = lambda c: F.floor(c * fine)
    placed = known.withColumn("bin", bin_of(F.col("s")))
    firsts = placed.groupBy("bin").agg(F.min(F.struct("s", "v")).alias("first")).withColumn("next", F.lead("first").over(Window.orderBy("bin"))).select("bin", "next")
    step = F.lead(F.struct("s", "v")).over(Window.partitionBy("bin").orderBy("s", "v"))
    steps = placed.withColumn("inside", step).join(firsts, "bin").withColumn("to", F.coalesce("inside", "next"))
    steps = steps.select("s", "v", F.col("to.s").alias("s2"), F.col("to.v").alias("v2")).where("s2 is null or s < s2")
    steps = steps.withColumn("bin", F.explode(F.sequence(bin_of(F.col("s")), bin_of(F.coalesce("s2", "s")))))
    held = table.withColumn("y", F.least(F.greatest(F.col(score), F.lit(b["low"])), F.lit(b["high"]))).withColumn("bin", bin_of(F.col("y")))
    found = held.join(steps.hint("merge"), (held["bin"] == steps["bin"]) & (F.col("y") >= F.col("s")) & (F.col("s2").isNull() | (F.col("y") < F.col("s2"))), "left")
    value = F.coalesce(F.col("v") + (F.col("y") - F.col("s")) / (F.col("s2") - F.col("s")) * (F.col("v2") - F.col("v")), F.col("v"))
    return found.select(*[F.col(c) for c in table.columns], value.alias("value"))


def axial_mean(table: DataFrame, angle: str, weight: str, by: list[str]) -> DataFrame:
    """Mean azimuth (0 to 180) and strength (0 to 1) of axes; weights must be finite and positive."""
    w, a = F.col(weight), F.radians(2 * F.col(angle))
    known = table.where((w > 0) & (w < float("inf")) & F.col(angle).isNotNull())
    sums = known.groupBy(*by).agg(F.sum(w * F.cos(a)).alias("c"), F.sum(w * F.sin(a)).alias("s"), F.sum(w).alias("w"))
    return sums.select(*by, F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)).alias("azimuth"), (F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("w")).alias("strength"))


def validation(table: DataFrame, fact: str, estimate: str, error: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean error, mean absolute error, RMSE, mean squared deviation ratio (positive errors only) and correlation."""
    e = F.col(estimate) - F.col(fact)
    aggs = [F.count(e).alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(fact, estimate).alias("r")]
    if error:
        aggs.append(F.avg(F.when(F.col(error) > 0, e * e / (F.col(error) * F.col(error)))).alias("msdr"))
    return table.groupBy(*(by or [])).agg(*aggs)
