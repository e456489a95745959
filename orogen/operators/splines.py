"""Multilevel B-spline surfaces over points (x, y, v), as joins and sums."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.operators.kriging import polynomial_trend


@dataclass
class Splines:
    """Lattices of coefficients (i, j, c), each with twice the cells of the one before, over one frame."""

    low: tuple[float, float]
    high: tuple[float, float]
    trend: dict[str, float]
    lattices: list[tuple[int, int, DataFrame]] = field(default_factory=list)
    worst: float = float("inf")


def _basis(t: Column) -> list[Column]:
    """The four cubic B-splines over a cell, at share ``t`` of it."""
    return [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]


def _supports(points: DataFrame, model: Splines, nx: int, ny: int) -> DataFrame:
    """``points`` once for each of the sixteen coefficients (i, j) that they lie under, with their weight w."""
    def place(c: str, low: float, high: float, n: int) -> tuple[Column, Column]:
        at = (F.col(c) - low) / (high - low) * n
        base = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n - 1))
        return base, at - base

    (bx, tx), (by, ty) = place("x", model.low[0], model.high[0], nx), place("y", model.low[1], model.high[1], ny)
    wx, wy = _basis(F.col("_tx")), _basis(F.col("_ty"))
    placed = points.withColumns({"_bx": bx, "_tx": tx, "_by": by, "_ty": ty})
    each = F.explode(F.array(*[F.struct((F.col("_bx") + a).alias("i"), (F.col("_by") + b).alias("j"), (wx[a] * wy[b]).alias("w")) for a in range(4) for b in range(4)])).alias("s")
    return placed.select(*points.columns, each).select(*points.columns, "s.*")


def _value(points: DataFrame, model: Splines, lattice: tuple[int, int, DataFrame]) -> DataFrame:
    """id and value of one lattice at points (id, x, y)."""
    nx, ny, c = lattice
    laid = _supports(points.select("id", "x", "y"), model, nx, ny).join(c, ["i", "j"], "left")
    return laid.groupBy("id").agg(F.sum(F.col("w") * F.coalesce("c", F.lit(0.0))).alias("value"))


def fit(points: DataFrame, grid: tuple[int, int] = (2, 2), levels: int = 8, tolerance: float | None = None, plane: bool = True) -> Splines:
    """Fit lattices to what the trend and the coarser lattices leave; a lattice has ``grid`` cells, then twice as many along each axis.

    Each point would give its sixteen coefficients w v / sum(w^2); a coefficient is the mean of what its points would give,
    weighted by w^2. Both are sums by point and by coefficient. It ends after ``levels``, or once no residual exceeds ``tolerance``.
    """
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("v").alias("v")).first()
    if b["x0"] is None:
        raise ValueError("no points")
    wide = lambda a, c: c if c > a else a + 1.0
    flat = {"mx": 0.0, "my": 0.0, "sx": 1.0, "sy": 1.0, "b0": b["v"], "b1": 0.0, "b2": 0.0}
    model = Splines((b["x0"], b["y0"]), (wide(b["x0"], b["x1"]), wide(b["y0"], b["y1"])), polynomial_trend(points, 1) if plane else flat)
    rest = checkpointed(points.select("id", "x", "y", (F.col("v") - _trend(model)).alias("v")))
    nx, ny = grid
    for _ in range(levels):
        laid = _supports(rest, model, nx, ny)
        total = rest.select("id", "x", "y")
        power = laid.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
        phi = laid.join(power, "id").withColumn("phi", F.try_divide(F.col("w") * F.col("v"), F.col("w2")))
        square = F.col("w") * F.col("w")
        c = checkpointed(phi.groupBy("i", "j").agg(F.try_divide(F.sum(square * F.col("phi")), F.sum(square)).alias("c")))
        model.lattices.append((nx, ny, c))
        rest = checkpointed(rest.join(_value(total, model, model.lattices[-1]), "id").select("id", "x", "y", (F.col("v") - F.col("value")).alias("v")))
        model.worst = rest.agg(F.max(F.abs("v"))).first()[0]
        if tolerance is not None and model.worst <= tolerance:
            break
        nx, ny = 2 * nx, 2 * ny
    return model


def _trend(model: Splines) -> Column:
    t = model.trend
    return t["b0"] + t["b1"] * (F.col("x") - t["mx"]) / t["sx"] + t["b2"] * (F.col("y") - t["my"]) / t["sy"]


def evaluate(model: Splines, targets: DataFrame) -> DataFrame:
    """id and value of the surface at targets (id, x, y) within its frame."""
    out = targets.select("id", "x", "y", _trend(model).alias("value"))
    for lattice in model.lattices:
        part = _value(targets, model, lattice).withColumnRenamed("value", "part")
        out = out.join(part, "id").select("id", "x", "y", (F.col("value") + F.col("part")).alias("value"))
    return out.select("id", "value")
