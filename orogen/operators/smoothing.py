"""Smoothing that keeps crests, terraces and banks: the field of normals is smoothed where it agrees, and heights follow it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed
from orogen.operators.raster import tiles

#: Slopes beyond this (rise by run) count as this steep.
STEEPEST = 10.0


def _normals(z: np.ndarray, cell: float) -> np.ndarray:
    """Unit normals (east, north, up) of the ground, by central differences, one-sided at the ends of the array."""
    south, east = np.gradient(z, cell) if min(z.shape) > 1 else (np.zeros_like(z), np.zeros_like(z))
    n = np.stack((-np.clip(east, -STEEPEST, STEEPEST), np.clip(south, -STEEPEST, STEEPEST), np.ones_like(z)))
    return n / np.sqrt((n * n).sum(0))


def _agreeing(n: np.ndarray, known: np.ndarray, axis: int, reach: int, cosine: float) -> np.ndarray:
    """Normals averaged along an axis with those within ``reach`` that point nearly the same way; ends repeat."""
    pad = [(0, 0), (0, 0), (0, 0)]
    pad[axis + 1] = (reach, reach)
    wide, there = np.pad(n, pad, mode="edge"), np.pad(known, pad[1:], mode="edge")
    total, count = n * known, known.astype(float)
    size = n.shape[axis + 1]
    for k in range(2 * reach + 1):
        if k == reach:
            continue
        own = (slice(k, k + size), slice(None)) if axis == 0 else (slice(None), slice(k, k + size))
        other = wide[(slice(None), *own)]
        w = there[own] & ((n * other).sum(0) >= cosine)
        total = total + other * w
        count += w
    mean = np.where(count > 0, total / np.maximum(count, 1), n)
    return mean / np.maximum(np.sqrt((mean * mean).sum(0)), 1e-9)


def _followed(z: np.ndarray, n: np.ndarray, known: np.ndarray, cell: float, share: float = 0.5) -> np.ndarray:
    """Heights moved by ``share`` towards what their four neighbours expect from the slopes between."""
    up = np.where(np.abs(n[2]) > 0.15, n[2], np.sign(n[2]) * 0.15 + 1e-9)
    slope = np.clip(-n[:2] / up, -STEEPEST, STEEPEST)
    total, count = np.zeros_like(z), np.zeros_like(z)
    for axis, sign, part, way in ((1, -1, 0, 1), (1, 1, 0, -1), (0, -1, 1, -1), (0, 1, 1, 1)):  # west, east, north, south
        pad = [(0, 0), (0, 0)]
        pad[axis] = (1, 1)
        size = z.shape[axis]
        own = [slice(None), slice(None)]
        own[axis] = slice(1 + sign, 1 + sign + size)
        side = lambda a: np.pad(a, pad, mode="edge")[tuple(own)]  # noqa: B023, E731
        here = side(known)
        total += np.where(here, side(z) + way * cell * (slope[part] + side(slope[part])) / 2, 0.0)
        count += here
    expected = np.where(count > 0, total / np.maximum(count, 1), z)
    return np.where(known, z + share * (expected - z), z)


def feature_preserving(cells: DataFrame, ny: int, nx: int, cell: float, turns: int = 2, passes: int = 5, size: int = 11, angle: float = 15.0, tile: int = 192) -> DataFrame:
    """row, col and z of a dense frame's heights, smoothed ``turns`` times without wearing off its edges.

    A turn averages normals ``passes`` times along columns, then rows, over ``size`` cells, with those that differ by ``angle`` degrees at most, and moves
    heights half way to what the slopes ask for. Nodata has no weight and stays; for the slopes beside it, it stands at the mean of all
    heights. A turn is one shuffle: tiles take along as many cells around them as its passes reach.
    """
    reach = max(1, size // 2)
    halo, cosine = passes * reach + 2, float(np.cos(np.radians(angle)))
    mean = cells.agg(F.avg("z")).first()[0]
    if mean is None:
        return cells.select("row", "col", F.col("z").cast("double").alias("z"))

    def smoothed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = max(0, key[0] * tile - halo), max(0, key[1] * tile - halo)
        r1, c1 = min(ny, (key[0] + 1) * tile + halo), min(nx, (key[1] + 1) * tile + halo)
        at = (frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0)
        z = np.full((r1 - r0, c1 - c0), np.nan)
        z[at] = frame["z"].to_numpy(float)
        known = np.isfinite(z)
        z[~known] = mean
        n = _normals(z, cell)
        for _ in range(passes):
            for axis in (0, 1):
                n = _agreeing(n, known, axis, reach, cosine)
        z = np.where(known, _followed(z, n, known, cell), np.nan)
        own = (frame["row"] // tile == key[0]) & (frame["col"] // tile == key[1])
        return frame[own].assign(z=z[at][own.to_numpy()])[["row", "col", "z"]]

    now = cells.select("row", "col", F.col("z").cast("double").alias("z"))
    for _ in range(turns):
        got = tiles(now, tile, halo).groupBy("tr", "tc").applyInPandas(smoothed, "row int, col int, z double")
        now = checkpointed(got.select("row", "col", F.when(~F.isnan("z"), F.col("z")).alias("z")))
    return now
