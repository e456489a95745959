"""Kriging: neighbours by an equi-join on bins, systems solved in batches by NumPy inside tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.joins import near_join
from orogen.functions.loops import checkpointed
from orogen.functions.scalar import gaussian_floor
from orogen.operators.raster import dense, tiles

#: What a power structure's covariance is taken from.
CEILING = 9999.0


@dataclass(frozen=True)
class Model:
    """A nugget and a structure, with ``nested`` ones beside it; ranges of exponential and gaussian structures aren't practical ranges.

    ``power`` has an exponent for a range, held between 0.05 and 1.999, and is taken from ``CEILING``. Gaussian structures raise the nugget to a hundredth of their sills
    at least, as systems are singular without. Nuggets of nested structures don't count.
    """

    kind: str
    sill: float
    reach: float
    nugget: float = 0.0
    azimuth: float = 0.0
    anisotropy: float = 1.0
    nested: tuple[Model, ...] = ()

    @property
    def parts(self) -> tuple[Model, ...]:
        return (self, *self.nested)

    @property
    def floor(self) -> float:
        """The nugget that holds."""
        return gaussian_floor(self.nugget, sum(p.sill for p in self.parts if p.kind == "gaussian"), "gaussian")

    @property
    def top(self) -> float:
        return self.floor + sum(CEILING if p.kind == "power" else p.sill for p in self.parts)

    def body(self, dx: np.ndarray, dy: np.ndarray, azimuth: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distances, stretched by the structure's own axes, and its covariances."""
        if self.anisotropy == 1.0:
            h = np.sqrt(dx * dx + dy * dy)
        else:
            a = np.radians(90.0 - (self.azimuth if azimuth is None else azimuth.reshape(-1, *[1] * (dx.ndim - 1))))
            h = np.hypot(dx * np.cos(a) + dy * np.sin(a), (dy * np.cos(a) - dx * np.sin(a)) / self.anisotropy)
        if self.kind == "power":
            return h, CEILING - self.sill * h ** min(max(self.reach, 0.05), 1.999)
        r = h / self.reach
        if self.kind == "spherical":
            r = np.minimum(r, 1.0)  # where the body is 0
            return h, self.sill * (1 + r * (0.5 * r * r - 1.5))
        return h, self.sill * {"exponential": lambda: np.exp(-r), "gaussian": lambda: np.exp(-r * r)}[self.kind]()

    def covariance(self, dx: np.ndarray, dy: np.ndarray, azimuth: np.ndarray | None = None) -> np.ndarray:
        """Covariance of lags; ``azimuth`` (one for each first index) stands in for the structures' own."""
        h, total = self.body(dx, dy, azimuth)
        for part in self.nested:
            total = total + part.body(dx, dy, azimuth)[1]
        return np.where(h < 1e-10, self.top, total)


def blocked(pairs: DataFrame, faults: DataFrame, radius: float) -> DataFrame:
    """``pairs`` (of ``near_join``) whose straight way no fault segment (x0, y0, x1, y1) crosses.

    A crossing is strict: a way that only touches a segment, or runs along it, is free. Segments fall into
    the bins of the targets from which a way of ``radius`` can reach them, so the anti join is an equi-join on bins, and never a broadcast. Pairs that
    bring their bins (``keep`` of ``near_join`` with the same radius) aren't shuffled again.
    """
    bins = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / radius), F.floor((F.greatest(a, b) + radius) / radius))
    near = faults.select("x0", "y0", "x1", "y1", F.explode(bins("x0", "x1")).alias("_bx"), bins("y0", "y1").alias("_by")).withColumn("_by", F.explode("_by"))
    laid = pairs if "_bx" in pairs.columns else pairs.withColumn("_bx", F.floor(F.col("l_x") / radius)).withColumn("_by", F.floor(F.col("l_y") / radius))
    p, f = laid.alias("p"), near.alias("f")
    side = lambda ax, ay, bx, by, cx, cy: (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
    ray, wall = ("p.l_x", "p.l_y", "p.r_x", "p.r_y"), ("f.x0", "f.y0", "f.x1", "f.y1")
    ends = side(*ray, "f.x0", "f.y0") * side(*ray, "f.x1", "f.y1")
    places = side(*wall, "p.l_x", "p.l_y") * side(*wall, "p.r_x", "p.r_y")
    same = (F.col("p._bx") == F.col("f._bx")) & (F.col("p._by") == F.col("f._by"))
    return p.join(f.hint("merge"), same & (ends < 0) & (places < 0), "left_anti").drop("_bx", "_by")


def neighbours(targets: DataFrame, samples: DataFrame, radius: float, most: int, exclude: bool = False, faults: DataFrame | None = None) -> DataFrame:
    """Targets (id, x, y) with ``near``, their at most ``most`` nearest samples (x, y, v, and ``a`` where they have an azimuth) within ``radius``.

    Equal distances go by x, then y, then v, so the order of rows never matters. ``exclude`` leaves out the
    sample with the target's id. Samples behind a fault (``blocked``) aren't seen.
    """
    extra = [c for c in ("a",) if c in samples.columns]
    found = near_join(targets.select("id", "x", "y"), samples.select("id", "x", "y", "v", *extra), radius, keep=faults is not None)
    if exclude:
        found = found.where("l_id <> r_id")
    if faults is not None:
        found = blocked(found, faults, radius)
    order = Window.partitionBy("l_id").orderBy("h", "r_x", "r_y", "r_v")
    kept = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    near = F.struct("k", *[F.col(f"r_{c}").alias(c) for c in ("x", "y", "v", *extra)])
    kept = kept.groupBy(F.col("l_id").alias("id")).agg(F.array_sort(F.collect_list(near)).alias("near"))
    return targets.join(kept, "id", "left")


def solve(tx: np.ndarray, ty: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, model: Model, mean: float | None, block: float = 0.0, grid: int = 1, azimuth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances of targets that all have the same number of neighbours: x, y, v are (targets, neighbours).

    Simple kriging with ``mean``, else ordinary, whose row is scaled by the covariance at 0. A block of
    side ``block`` is averaged over ``grid`` x ``grid`` places. A target on a sample takes its value with variance 0. Where
    a system has no solution or its estimate leaves the neighbours' range by three spans, the estimate is inverse-distance
    weighted (power 2) and the variance the block's.
    """
    m, n = x.shape
    at = (np.arange(grid) + 0.5) / grid * block - block / 2
    ox, oy = (a.ravel() for a in np.meshgrid(at, at)) if block and grid > 1 else (np.zeros(1), np.zeros(1))
    a = model.covariance(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :], azimuth)
    b = model.covariance(x[:, :, None] - (tx[:, None, None] + ox), y[:, :, None] - (ty[:, None, None] + oy), azimuth).mean(2)
    cbb = model.top
    if len(ox) > 1:
        within = model.covariance(ox[:, None] - ox, oy[:, None] - oy)
        np.fill_diagonal(within, model.sill)  # the nugget doesn't count inside a block
        cbb = float(within.mean())
    a = a + 1e-9 * model.top * np.eye(n)
    if mean is None:
        full = np.zeros((m, n + 1, n + 1))
        full[:, :n, :n] = a
        full[:, :n, n] = full[:, n, :n] = model.top
        right = np.concatenate((b, np.full((m, 1), model.top)), 1)
    else:
        full, right = a, b
    try:
        weights = np.linalg.solve(full, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        weights = np.stack([np.linalg.lstsq(f, r, rcond=None)[0] for f, r in zip(full, right, strict=True)])
    k = weights[:, :n]
    estimate = (k * v).sum(1) if mean is None else mean + (k * (v - mean)).sum(1)
    variance = cbb - (k * b).sum(1) - (weights[:, n] * model.top if mean is None else 0.0)
    low, high = v.min(1), v.max(1)
    span = 3 * (high - low)
    d2 = (x - tx[:, None]) ** 2 + (y - ty[:, None]) ** 2
    bad = ~np.isfinite(estimate) | (estimate < low - span - 1e-9) | (estimate > high + span + 1e-9)
    if bad.any():
        w = 1 / np.maximum(d2[bad], 1e-20)
        estimate[bad], variance[bad] = (w * v[bad]).sum(1) / w.sum(1), cbb
    if len(ox) == 1:
        hit = d2.min(1) < 1e-20
        estimate[hit], variance[hit] = v[hit, d2[hit].argmin(1)], 0.0
    return estimate, np.maximum(variance, 0.0)


def _batches(sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Rows with equal numbers of neighbours, ``least`` at least, as many at a time as keep their matrices in a core's cache."""
    for n in np.unique(sizes[sizes >= max(least, 1)]):
        at = np.flatnonzero(sizes == n)
        yield from np.array_split(at, max(1, len(at) * int(n) * int(n) // 60_000))


def _axial(angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean azimuth and strength of axes along the last axis, leaving out those that are missing."""
    known = np.isfinite(angles)
    t, n = np.radians(2 * np.where(known, angles, 0.0)), np.maximum(known.sum(-1), 1)
    c, s = (np.cos(t) * known).sum(-1) / n, (np.sin(t) * known).sum(-1) / n
    return np.degrees(np.arctan2(s, c)) / 2 % 180, np.hypot(c, s)


def _nearest(tx: np.ndarray, ty: np.ndarray, sample: dict[str, np.ndarray], radius: float, most: int, ids: np.ndarray | None, walls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the at most ``most`` samples nearest to each target, by distance and then by their own order, padded with -1; and how many there are."""
    dx, dy = sample["x"] - tx[:, None], sample["y"] - ty[:, None]
    h = np.sqrt(dx * dx + dy * dy)
    free = h <= radius
    if ids is not None:
        free &= sample["id"] != ids[:, None]
    if len(walls):
        i, j = np.nonzero(free)
        ax, ay, bx, by = tx[i], ty[i], sample["x"][j], sample["y"][j]
        for x0, y0, x1, y1 in walls:
            ends = ((bx - ax) * (y0 - ay) - (by - ay) * (x0 - ax)) * ((bx - ax) * (y1 - ay) - (by - ay) * (x1 - ax))
            places = ((x1 - x0) * (ay - y0) - (y1 - y0) * (ax - x0)) * ((x1 - x0) * (by - y0) - (y1 - y0) * (bx - x0))
            hit = (ends < 0) & (places < 0)
            free[i[hit], j[hit]] = False
    h[~free] = np.inf
    if h.shape[1] > most:
        free &= h <= np.partition(h, most - 1, axis=1)[:, most - 1 : most]
    i, j = np.nonzero(free)
    order = np.lexsort((j, h[i, j], i))
    i, j = i[order], j[order]
    count = np.bincount(i, minlength=len(tx))
    rank = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    near = np.full((len(tx), most), -1)
    keep = rank < most
    near[i[keep], rank[keep]] = j[keep]
    return near, np.minimum(count, most)


def krige(targets: DataFrame, samples: DataFrame, model: Model, radius: float, most: int = 24, least: int = 4, mean: float | None = None, block: float = 0.0, grid: int = 1, exclude: bool = False, faults: DataFrame | None = None, strength: float = 0.3, tile: int = 1000) -> DataFrame:
    """id, estimate, variance and n_near of targets (id, x, y); both null with fewer than ``least`` neighbours.

    Targets fall into square tiles of some ``tile`` targets, as wide as the radius at least but where targets crowd; samples go to every tile within
    the radius, and so do fault segments, so a task finds the neighbours of its tile and solves their systems in batches; neighbours are never
    rows. They are those of ``neighbours``: the nearest, ties by x, y and v, seen past no fault. Samples may bring azimuths ``a`` of a
    local fabric: where those of a target's neighbours agree (axial mean of ``strength`` at least), the whole system takes the model turned to their mean.
    """
    names = ["id", "x", "y", "v"] + (["a"] if "a" in samples.columns else [])
    schema = "id long, estimate double, variance double, n_near int"
    b = targets.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not b["n"]:
        return targets.sparkSession.createDataFrame([], schema)
    area = max(b["x1"] - b["x0"], radius) * max(b["y1"] - b["y0"], radius)
    side = max(radius, math.sqrt(area * tile / b["n"]))
    span = lambda low, high: F.sequence(F.floor((low - radius) / side), F.floor((high + radius) / side))
    left = targets.select("id", "x", "y", F.floor(F.col("x") / side).alias("tc"), F.floor(F.col("y") / side).alias("tr"))
    null = F.lit(None).cast("double")
    right = samples.select(*[F.col(c).cast("long" if c == "id" else "double").alias(c) for c in names], null.alias("x1"), null.alias("y1"), F.explode(span(F.col("x"), F.col("x"))).alias("tc"), span(F.col("y"), F.col("y")).alias("tr"))
    if faults is not None:
        walls = faults.select(F.lit(None).cast("long").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"), *[null.alias(c) for c in names[3:]], "x1", "y1", F.explode(span(F.least("x0", "x1"), F.greatest("x0", "x1"))).alias("tc"), span(F.least("y0", "y1"), F.greatest("y0", "y1")).alias("tr"))
        right = right.union(walls)
    right = right.withColumn("tr", F.explode("tr"))

    def run(t: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame({"id": [], "estimate": [], "variance": [], "n_near": []})
        is_wall = known["x1"].notna()
        walls = known.loc[is_wall, ["x", "y", "x1", "y1"]].to_numpy(float)
        known = known[~is_wall & known["v"].notna()].sort_values(["x", "y", "v"], kind="stable")
        sample = {c: known[c].to_numpy() for c in names}
        tx, ty = t["x"].to_numpy(float), t["y"].to_numpy(float)
        ids = t["id"].to_numpy() if exclude else None
        estimate, variance, size = np.full(len(t), np.nan), np.full(len(t), np.nan), np.zeros(len(t), int)
        rows = max(1, 250_000 // max(1, len(known)))
        for at in range(0, len(t), rows):
            own = slice(at, at + rows)
            near, size[own] = _nearest(tx[own], ty[own], sample, radius, most, None if ids is None else ids[own], walls)
            for part in _batches(size[own], least):
                n = size[at + part[0]]
                pick = near[part, :n]
                x, y, v, *a = (sample[c][pick].astype(float) for c in names[1:])
                azimuth = None
                if a:
                    azimuth, agree = _axial(a[0])
                    azimuth = np.where(agree >= strength, azimuth, model.azimuth)
                part = part + at
                estimate[part], variance[part] = solve(tx[part], ty[part], x, y, v, model, mean, block, grid, azimuth)
        return pd.DataFrame({"id": t["id"], "estimate": estimate, "variance": variance, "n_near": size})

    # Where targets crowd, a tile is quartered until its parts hold some ``tile`` of them; samples go to the parts within the radius.
    full = left.groupBy("tr", "tc").agg(F.count("*").alias("m")).where(F.col("m") > 2 * tile)
    parts = checkpointed(full.select("tr", "tc", F.pow(F.lit(2), F.least(F.lit(10), F.ceil(F.log(4.0, F.col("m") / tile)))).cast("int").alias("parts")))
    place = lambda c, t: F.floor((F.col(c) - F.col(t) * side) / (side / F.col("parts")))
    left = left.join(parts, ["tr", "tc"], "left").select("id", "x", "y", "tr", "tc", *[F.when(F.col("parts").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(place(c, t), F.col("parts") - 1))).cast("int").alias(k) for c, t, k in (("y", "tr", "sr"), ("x", "tc", "sc"))])

    def reached(c: str, t: str) -> Column:
        at = lambda v: F.floor((v - F.col(t) * side) / (side / F.col("parts"))).cast("int")
        low, high = F.least(F.col(c), F.coalesce(f"{c}1", c)) - radius, F.greatest(F.col(c), F.coalesce(f"{c}1", c)) + radius
        first, last = F.greatest(F.lit(0), F.least(at(low), F.col("parts") - 1)), F.least(F.col("parts") - 1, F.greatest(at(high), F.lit(0)))
        return F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))

    right = right.join(parts, ["tr", "tc"], "left").withColumn("sr", F.explode(reached("y", "tr"))).withColumn("sc", F.explode(reached("x", "tc"))).drop("parts")
    # Tiles are few bytes but much work, so their number decides the tasks, not their size.
    n = max(-(-b["n"] // (50 * tile)), min(-(-b["n"] // tile), targets.sparkSession.sparkContext.defaultParallelism))
    keys = ["tr", "tc", "sr", "sc"]
    left, right = (part.repartition(n, *keys).groupBy(*keys) for part in (left, right))
    got = left.cogroup(right).applyInPandas(lambda t, known: run(t, known), schema)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("estimate", "variance")})


def cross_validate(samples: DataFrame, model: Model, radius: float, most: int = 24, least: int = 4, mean: float | None = None, faults: DataFrame | None = None) -> DataFrame:
    """id, v, estimate and variance of every sample from the others."""
    got = krige(samples.select("id", "x", "y"), samples, model, radius, most, least, mean, exclude=True, faults=faults)
    return got.join(samples.select("id", "v"), "id")


def cross_validate_detrended(samples: DataFrame, model: Model, degree: int, radius: float, most: int = 24, least: int = 4) -> DataFrame:
    """id, v, estimate and variance of every sample from the others: the trend is fitted, and its rest kriged, without the sample.

    The fit without a sample follows from that with it: coefficients move by the inverse normal matrix times
    the sample's terms times its error over one less its leverage. So one aggregate serves all samples.
    """
    trend, inverse = _trend(samples, degree)
    mx, my, sx, sy = (trend[k] for k in ("mx", "my", "sx", "sy"))
    beta = np.array([trend[f"b{i}"] for i in range(len(inverse))])

    def terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = (x - mx) / sx, (y - my) / sy
        return np.stack([np.ones_like(x), x, y] + ([x * x, x * y, y * y] if degree == 2 else []), -1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = {c: frame[f"n{c}"].to_numpy() for c in "xyv"}
            size = np.array([0 if r is None else len(r) for r in near["x"]], int)
            estimate, variance = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
            tx, ty, own = (frame[c].to_numpy(float) for c in "xyv")
            at = terms(tx, ty)
            lever = np.einsum("ij,jk,ik->i", at, inverse, at)
            without = beta - (at @ inverse) * ((own - at @ beta) / np.maximum(1 - lever, 1e-12))[:, None]
            for part in _batches(size, least):
                x, y, v = (np.stack(near[c][part]).astype(float) for c in "xyv")
                rest = v - np.einsum("inj,ij->in", terms(x, y), without[part])
                e, variance[part] = solve(tx[part], ty[part], x, y, rest, model, None)
                estimate[part] = e + (at[part] * without[part]).sum(1)
            yield pd.DataFrame({"id": frame["id"], "v": own, "estimate": estimate, "variance": variance})

    found = neighbours(samples.select("id", "x", "y", "v"), samples, radius, most, exclude=True)
    found = found.select("id", "x", "y", "v", *[F.col(f"near.{c}").alias(f"n{c}") for c in "xyv"])
    got = found.mapInPandas(run, "id long, v double, estimate double, variance double")
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("estimate", "variance")})


def drift(samples: DataFrame, degree: int = 1) -> dict[str, float]:
    """Coefficients of v on an outer variable ``s`` (standardised, degree 1 or 2) from sums of powers, with its mean and scale."""
    b = samples.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    scale = b["d"] or 1.0
    s, n = (F.col("s") - b["m"]) / scale, degree + 1
    sums = samples.agg(*[F.sum(F.pow(s, F.lit(float(k)))).alias(f"a{k}") for k in range(2 * n - 1)], *[F.sum(F.pow(s, F.lit(float(k))) * F.col("v")).alias(f"b{k}") for k in range(n)]).first()
    matrix = np.array([[sums[f"a{i + j}"] for j in range(n)] for i in range(n)], float)
    beta = np.linalg.lstsq(matrix, np.array([sums[f"b{k}"] for k in range(n)], float), rcond=None)[0]
    return {"mean": b["m"], "scale": scale} | {f"b{k}": float(v) for k, v in enumerate(beta)}


def drift_at(s, found: dict[str, float]):
    """The drift as a column of ``s``."""
    t = (s - found["mean"]) / found["scale"]
    return F.lit(found["b0"]) + found["b1"] * t + (found.get("b2", 0.0) * t * t)


def krige_with_drift(targets: DataFrame, samples: DataFrame, model: Model, radius: float, degree: int = 1, **options) -> DataFrame:
    """id, estimate, variance and n_near of targets (id, x, y, s) from samples (id, x, y, v, s): the drift in ``s`` plus the kriged rest."""
    found = drift(samples.where("s is not null and v is not null"), degree)
    rest = samples.where("s is not null and v is not null").withColumn("v", F.col("v") - drift_at(F.col("s"), found)).drop("s")
    got = krige(targets.select("id", "x", "y"), rest, model, radius, **options)
    return got.join(targets.select("id", "s"), "id").withColumn("estimate", F.col("estimate") + drift_at(F.col("s"), found)).drop("s")


def inverse_distance(targets: DataFrame, samples: DataFrame, radius: float, most: int = 12, exclude: bool = False) -> DataFrame:
    """id and estimate by inverse squared distance over the nearest samples; a sample at the target wins."""
    found = near_join(targets.select("id", "x", "y"), samples.select("id", "x", "y", "v"), radius)
    if exclude:
        found = found.where("l_id <> r_id")
    kept = found.withColumn("k", F.row_number().over(Window.partitionBy("l_id").orderBy("h", "r_x", "r_y", "r_v"))).where(F.col("k") <= most)
    w = F.when(F.col("h") > 0, F.try_divide(F.lit(1.0), F.col("h") * F.col("h")))
    return kept.groupBy(F.col("l_id").alias("id")).agg(F.coalesce(F.avg(F.when(F.col("h") == 0, F.col("r_v"))), F.sum(w * F.col("r_v")) / F.sum(w)).alias("estimate"))


def indicators(targets: DataFrame, samples: DataFrame, classes: list, models: dict, radius: float, most: int = 24, least: int = 4) -> DataFrame:
    """id, class, probability and ``best``: simple kriging of each class's 0/1 indicator with its share as mean, clipped and normalised.

    Neighbours are searched once; each task solves the systems of all classes. ``classes`` are few.
    """
    shares = {r["class"]: r["n"] for r in samples.groupBy("class").agg(F.count("*").alias("n")).collect()}
    n = max(sum(shares.values()), 1)
    number = F.coalesce(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))])[F.col("class")], F.lit(-1.0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = {c: frame[f"n{c}"].to_numpy() for c in "xyv"}
            size = np.array([0 if r is None else len(r) for r in near["x"]], int)
            tx, ty = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
            p = np.full((len(frame), len(classes)), np.nan)
            for part in _batches(size, least):
                x, y, v = (np.stack(near[c][part]).astype(float) for c in "xyv")
                for k, c in enumerate(classes):
                    p[part, k] = solve(tx[part], ty[part], x, y, (v == k).astype(float), models[c], shares.get(c, 0) / n)[0]
            p = np.clip(p, 0.0, 1.0)
            total = p.sum(1)
            share = np.divide(p, total[:, None], out=np.full_like(p, np.nan), where=(total > 0)[:, None])
            first = np.where(np.isfinite(total), p.argmax(1), -1)
            known = np.isfinite(total)
            for k in range(len(classes)):
                yield pd.DataFrame({"id": frame["id"][known], "k": k, "probability": share[known, k], "best": (first == k)[known]})

    found = neighbours(targets, samples.select("id", "x", "y", number.alias("v")), radius, most)
    found = found.select("id", "x", "y", *[F.col(f"near.{c}").alias(f"n{c}") for c in "xyv"])
    got = found.mapInPandas(run, "id long, k int, probability double, best boolean")
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("k") + 1)
    return got.select("id", label.alias("class"), F.when(~F.isnan("probability"), F.col("probability")).alias("probability"), "best")


def polynomial_trend(samples: DataFrame, degree: int) -> dict[str, float]:
    """Coefficients of a plane or quadratic in standardised coordinates, from sums of products, and the scales."""
    return _trend(samples, degree)[0]


def _trend(samples: DataFrame, degree: int) -> tuple[dict[str, float], np.ndarray]:
    """The trend and the inverse of its normal matrix."""
    b = samples.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    sx, sy = b["sx"] or 1.0, b["sy"] or 1.0
    x, y = (F.col("x") - b["mx"]) / sx, (F.col("y") - b["my"]) / sy
    terms = [F.lit(1.0), x, y] + ([x * x, x * y, y * y] if degree == 2 else [])
    k = len(terms)
    products = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = samples.agg(*products, *[F.sum(terms[i] * F.col("v")).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    inverse = np.linalg.pinv(a)
    beta = inverse @ np.array([sums[f"b{i}"] for i in range(k)], float)
    return {"mx": b["mx"], "my": b["my"], "sx": sx, "sy": sy} | {f"b{i}": float(v) for i, v in enumerate(beta)}, inverse


def detrended(samples: DataFrame, trend: dict[str, float]) -> DataFrame:
    """Samples with the trend taken off ``v``."""
    x, y = (F.col("x") - trend["mx"]) / trend["sx"], (F.col("y") - trend["my"]) / trend["sy"]
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y]
    return samples.withColumn("v", F.col("v") - sum((trend[f"b{i}"] * t for i, t in enumerate(terms) if f"b{i}" in trend), F.lit(0.0)))


def simulate(samples: DataFrame, model: Model, x0: float, y0: float, cell: float, ny: int, nx: int, realisations: int, most: int = 16, window: int = 25, seed: int = 1, tile: int = 64) -> DataFrame:
    """realisation, row, col, score: sequential gaussian simulation of normal scores ``v`` with mean 0.

    Samples are fixed at their nearest node of the frame (of several, the last by x, y and v). Each other node is drawn
    from simple kriging on the nearest known nodes within ``window`` cells. The path goes tile by tile in four
    turns, as on a chessboard of four colours, and at random within a tile: tiles of one turn lie more than ``window``
    cells apart, so they don't see each other, and each is a task with the nodes around it that samples and earlier turns have made.
    """
    tile = max(tile, window + 1)
    node = lambda c, low, n: F.least(F.greatest(F.rint((F.col(c) - low) / cell), F.lit(0)), F.lit(n - 1)).cast("int")
    known = samples.where("x is not null and y is not null and v is not null")
    fixed = known.groupBy(node("y", y0, ny).alias("row"), node("x", x0, nx).alias("col")).agg(F.max(F.struct("x", "y", "v"))["v"].alias("z"))
    now = dense(fixed, ny, nx).select(F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))).alias("realisation"), "row", "col", F.col("z").alias("score"))
    now = checkpointed(now.withColumn("realisation", F.col("realisation").cast("long")))
    turn = lambda r, c: (F.pmod(r, F.lit(2)) * 2 + F.pmod(c, F.lit(2)))

    reach = np.arange(-window, window + 1)
    di, dj = (d.ravel() for d in np.meshgrid(reach, reach, indexing="ij"))
    near = np.lexsort((dj, di, di * di + dj * dj))[1:]  # around a node, nearest first
    di, dj = di[near], dj[near]
    lag = np.arange(-2 * window, 2 * window + 1) * cell
    table = model.covariance(lag[None, :] + 0.0 * lag[:, None], lag[:, None] + 0.0 * lag[None, :])

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Which nodes are known to a node, and so its weights, follows from the path alone: they are found and solved for many nodes at once, and only values are drawn one by one."""
        run, tr, tc = (int(k) for k in key)
        r0, c0 = max(0, tr * tile - window), max(0, tc * tile - window)
        height, width = min(ny, (tr + 1) * tile + window) - r0, min(nx, (tc + 1) * tile + window) - c0
        wide = width + 2 * window  # a rim of unknown nodes, so that no window leaves the array
        z = np.full((height + 2 * window) * wide, np.nan)
        rows, cols = frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0
        place = (rows + window) * wide + cols + window
        z[place] = frame["score"].to_numpy(float)
        own = np.flatnonzero(((frame["row"] // tile == tr) & (frame["col"] // tile == tc)).to_numpy())
        rng = np.random.default_rng((seed, run, tr, tc))
        own = own[np.lexsort((cols[own], rows[own]))]
        path = place[rng.permutation(own)]
        path = path[np.isnan(z[path])]
        when = np.where(np.isnan(z), len(path), -1)
        when[path] = np.arange(len(path))
        noise, steps = rng.normal(size=len(path)), di * wide + dj
        size, picks = np.zeros(len(path), int), np.zeros((len(path), most), int)
        todo = np.arange(len(path))
        for ahead in (8 * most, len(steps)):  # mostly the first steps do
            later = []
            for part in np.array_split(todo, max(1, len(todo) * min(ahead, len(steps)) // 1_000_000)):
                known = when[path[part, None] + steps[:ahead]] < part[:, None]
                count = known.cumsum(1)
                size[part] = np.minimum(count[:, -1], most) if len(steps) else 0
                at, step = np.nonzero(known & (count <= most))
                picks[part[at], count[at, step] - 1] = step
                later.append(part[size[part] < most])
            todo = np.concatenate(later)
        weights, deviation = np.zeros((len(path), most)), np.full(len(path), np.sqrt(model.top))
        for part in _batches(size, 1):
            i, j = di[picks[part, : size[part[0]]]], dj[picks[part, : size[part[0]]]]
            a = table[i[:, :, None] - i[:, None, :] + 2 * window, j[:, :, None] - j[:, None, :] + 2 * window] + 1e-9 * model.top * np.eye(i.shape[1])
            right = table[i + 2 * window, j + 2 * window]
            try:
                k = np.linalg.solve(a, right[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                k = np.stack([np.linalg.lstsq(f, r, rcond=None)[0] for f, r in zip(a, right, strict=True)])
            weights[part, : i.shape[1]], deviation[part] = k, np.sqrt(np.maximum(model.top - (k * right).sum(1), 0.0))
        around = path[:, None] + steps[picks] if len(steps) else path[:, None]
        for k, (node, n) in enumerate(zip(path.tolist(), size.tolist(), strict=True)):
            if not n:
                z[node] = noise[k] * deviation[k]
                continue
            v = z[around[k, :n]]
            e, low, high = float(weights[k, :n] @ v), float(v.min()), float(v.max())
            s, span = deviation[k], 3 * (high - low) + 1e-9
            if not low - span <= e <= high + span:  # as ``solve`` has it
                w = 1 / ((di[picks[k, :n]] ** 2 + dj[picks[k, :n]] ** 2) * float(cell) ** 2)
                e, s = float((w * v).sum() / w.sum()), np.sqrt(model.top)
            z[node] = e + noise[k] * s
        return frame.iloc[own][["realisation", "row", "col"]].assign(score=z[place[own]])

    # Tiles are few bytes but much work, so their number decides the tasks, not their size.
    keys = ["realisation", "tr", "tc"]
    n = max(samples.sparkSession.sparkContext.defaultParallelism, realisations * ny * nx // (16 * tile * tile))
    for k in range(4):
        mine = turn(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)) == k
        laid = tiles(now, tile, window).where(turn(F.col("tr"), F.col("tc")) == k).where((F.col("tr") >= 0) & (F.col("tc") >= 0))
        laid = laid.where((F.floor(F.col("row") / tile) == F.col("tr")) & (F.floor(F.col("col") / tile) == F.col("tc")) | F.col("score").isNotNull())
        done = laid.repartition(n, *keys).groupBy(*keys).applyInPandas(one, "realisation long, row int, col int, score double")
        now = checkpointed(now.where(~mine).unionByName(done))
    return now
