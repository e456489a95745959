"""Surfaces of minimum curvature in tension through scattered points, solved coarse to fine on overlapping tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions.loops import fixpoint
from orogen.operators.raster import tiles

#: Weights of the nodes around one that has no bending: next neighbours, diagonal ones, those two steps off (of 20).
_PLATE = {(1, 0): 8.0, (0, 1): 8.0, (-1, 0): 8.0, (0, -1): 8.0, (1, 1): -2.0, (1, -1): -2.0, (-1, 1): -2.0, (-1, -1): -2.0, (2, 0): -1.0, (0, 2): -1.0, (-2, 0): -1.0, (0, -2): -1.0}
_SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))


def snapped(points: DataFrame, x0: float, y0: float, cell: float, ny: int, nx: int) -> DataFrame:
    """row, col and pin: the mean of the points (x, y, v) of a node's cell; row 0 lies north, points beyond the frame go to its edge."""
    held = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(n - 1))).cast("int")
    row, col = held((y0 + ny * cell - F.col("y")) / cell, ny), held((F.col("x") - x0) / cell, nx)
    return points.where("v is not null").groupBy(row.alias("row"), col.alias("col")).agg(F.avg("v").cast("double").alias("pin"))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Which side of a line from a to b a point lies on; on the line counts as the left."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0


def blocked_edges(faults: DataFrame, x0: float, y0: float, cell: float, ny: int, nx: int) -> DataFrame:
    """row, col, e and s: nodes whose way to the next node east or south a fault segment (x0, y0, x1, y1) crosses.

    A node on a fault belongs to its left side, so a fault through nodes still parts them. Each segment is laid out over the
    rows it touches and the columns it may cross there, so the work is its length.
    """
    top = y0 + ny * cell
    fr = lambda y: (top - F.col(y)) / cell - 0.5
    fc = lambda x: (F.col(x) - x0) / cell - 0.5
    laid = faults.select(fc("x0").alias("ac"), fr("y0").alias("ar"), fc("x1").alias("bc"), fr("y1").alias("br"))
    span = lambda a, b, n: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b)).cast("int") - 1), F.least(F.lit(n - 1), F.ceil(F.greatest(a, b)).cast("int") + 1))
    inside = (F.least("ar", "br") < ny) & (F.greatest("ar", "br") > -1) & (F.least("ac", "bc") < nx) & (F.greatest("ac", "bc") > -1)
    rows = laid.where(inside).withColumn("row", F.explode(span(F.col("ar"), F.col("br"), ny)))
    # Where the segment is while it passes the rows just above to just below this one.
    at = lambda r: F.when(F.col("br") == F.col("ar"), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - F.col("ar")) / (F.col("br") - F.col("ar")))))
    col_at = lambda t: F.col("ac") + t * (F.col("bc") - F.col("ac"))
    rows = rows.withColumn("ca", F.coalesce(col_at(at(F.col("row") - 1.0)), F.col("ac"))).withColumn("cb", F.coalesce(col_at(at(F.col("row") + 1.0)), F.col("bc")))
    first, last = F.greatest(F.lit(0), F.floor(F.least("ca", "cb")).cast("int") - 1), F.least(F.lit(nx - 1), F.ceil(F.greatest("ca", "cb")).cast("int") + 1)
    nodes = rows.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("col", F.explode(F.sequence("first", "last")))
    ax, ay, bx, by = F.col("ac"), -F.col("ar"), F.col("bc"), -F.col("br")
    px, py = F.col("col").cast("double"), -F.col("row").cast("double")

    def crossed(qx: Column, qy: Column) -> Column:
        return (_turn(ax, ay, bx, by, px, py) != _turn(ax, ay, bx, by, qx, qy)) & (_turn(px, py, qx, qy, ax, ay) != _turn(px, py, qx, qy, bx, by))

    found = nodes.select("row", "col", ((F.col("col") < nx - 1) & crossed(px + 1, py)).alias("e"), ((F.col("row") < ny - 1) & crossed(px, py - 1)).alias("s"))
    return found.where("e or s").groupBy("row", "col").agg(F.bool_or("e").alias("e"), F.bool_or("s").alias("s"))


def _beside(edges: DataFrame, ny: int, nx: int) -> DataFrame:
    """row, col, e, s and near of the nodes within two steps of a blocked edge's ends."""
    ends = edges.select("row", "col").union(edges.where("e").select("row", F.col("col") + 1)).union(edges.where("s").select(F.col("row") + 1, "col"))
    reach = F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2])
    near = ends.select(F.explode(reach).alias("k")).select("k.row", "k.col").where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)).distinct()
    return near.join(edges, ["row", "col"], "left").select("row", "col", F.coalesce("e", F.lit(False)).alias("e"), F.coalesce("s", F.lit(False)).alias("s"), F.lit(True).alias("near"))


class Plate:
    """The linear rule that every free node follows on a piece of the frame, with ghost nodes beyond the frame's own edges.

    Away from faults a node is where a plate in tension has no bending (the share ``tension`` of a membrane); beyond an edge the
    plate goes on straight. Within two nodes of a fault it is the mean of the neighbours it isn't parted from.
    """

    def __init__(self, shape: tuple[int, int], frame: tuple[bool, bool, bool, bool], e: np.ndarray, s: np.ndarray, near: np.ndarray, tension: float, edge_tension: float, aspect: float):
        self.shape, self.frame = shape, frame  # whether the piece ends at the frame's north, south, west and east
        self.e, self.s, self.near, self.aspect = e, s, near, aspect
        self.tension = np.full(shape, tension)
        for at, outer in zip((np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]), frame, strict=True):
            if outer:
                self.tension[at] = max(tension, edge_tension)
        self.open = {(0, 1): ~e, (0, -1): ~np.pad(e, ((0, 0), (1, 0)))[:, :-1], (1, 0): ~s, (-1, 0): ~np.pad(s, ((1, 0), (0, 0)))[:-1]}
        rows, cols = np.indices(shape)
        for (i, j), free in self.open.items():
            free &= (rows + i >= 0) & (rows + i < shape[0]) & (cols + j >= 0) & (cols + j < shape[1])

    def ghosts(self, p: np.ndarray) -> None:
        """Set the two rings of nodes beyond the frame so that the surface goes on straight across its edge."""
        north, south, west, east = self.frame
        for k in (1, 2):
            if north:
                p[2 - k, 2:-2] = (k + 1) * p[2, 2:-2] - k * p[3, 2:-2]
            if south:
                p[-3 + k, 2:-2] = (k + 1) * p[-3, 2:-2] - k * p[-4, 2:-2]
        for k in (1, 2):
            if west:
                p[:, 2 - k] = (k + 1) * p[:, 2] - k * p[:, 3]
            if east:
                p[:, -3 + k] = (k + 1) * p[:, -3] - k * p[:, -4]

    def rule(self, p: np.ndarray) -> np.ndarray:
        """Where the nodes belong, given all others (``p`` with its ghosts)."""
        ny, nx = self.shape
        at = lambda i, j: p[2 + i : 2 + i + ny, 2 + j : 2 + j + nx]
        bend = sum(w * at(i, j) for (i, j), w in _PLATE.items()) / 20.0
        flat = (at(0, 1) + at(0, -1) + self.aspect * (at(1, 0) + at(-1, 0))) / (2 + 2 * self.aspect)
        out = bend + self.tension * (flat - bend)
        if self.near.any():
            count = sum(self.open[side].astype(float) for side in _SIDES)
            mean = sum(np.where(self.open[side], at(*side), 0.0) for side in _SIDES) / np.maximum(count, 1)
            out = np.where(self.near, np.where(count > 0, mean, at(0, 0)), out)
        return out

    def off(self, z: np.ndarray) -> np.ndarray:
        """How far each node is from where it belongs."""
        p = np.zeros((self.shape[0] + 4, self.shape[1] + 4))
        p[2:-2, 2:-2] = z
        self.ghosts(p)
        return z - self.rule(p)

    def solved(self, z: np.ndarray, free: np.ndarray, hold: float = 1e-10) -> np.ndarray:
        """The piece with its free nodes where they belong, all at once.

        The rule reaches two nodes, so 25 combs of unit nodes tell every coefficient, and pairs of rows make a block tridiagonal
        system. ``hold`` draws nodes to where they are, so what the pins leave open stays; at a fixed point it has no effect.
        """
        ny, nx = self.shape
        comb = np.zeros((5, 5, ny, nx))
        for a in range(5):
            for b in range(5):
                unit = np.zeros(self.shape)
                unit[a::5, b::5] = 1.0
                comb[a, b] = np.where(free, self.off(unit), 0.0)
        wrong = np.where(free, -self.off(z), 0.0)
        cols, ahead, right, solved = np.arange(nx), [], [], np.zeros((ny, nx))
        for r0 in range(0, ny, 2):
            rows = min(2, ny - r0)
            strip = np.zeros((rows, nx, 6, nx))  # rows r0 - 2 to r0 + 3
            for i in range(rows):
                for di in range(-2, 3):
                    if not 0 <= r0 + i + di < ny:
                        continue
                    for dj in range(-2, 3):
                        j = cols[max(0, -dj) : nx - max(0, dj)]
                        strip[i, j, 2 + i + di, j + dj] = comb[(r0 + i + di) % 5, (j + dj) % 5, r0 + i, j]
                strip[i, cols, 2 + i, cols] += np.where(free[r0 + i], hold, 1.0)
            strip = strip.reshape(rows * nx, 6 * nx)
            own, rhs = strip[:, 2 * nx : (2 + rows) * nx], wrong[r0 : r0 + rows].ravel()
            after = min(2, ny - r0 - rows)
            if ahead:
                own, rhs = own - strip[:, : 2 * nx] @ ahead[-1], rhs - strip[:, : 2 * nx] @ right[-1]
            both = np.linalg.solve(own, np.column_stack((strip[:, (2 + rows) * nx : (2 + rows + after) * nx], rhs)))
            ahead.append(both[:, :-1])
            right.append(both[:, -1])
        later = np.zeros(0)
        for k in range(len(ahead) - 1, -1, -1):
            later = right[k] - ahead[k] @ later
            solved[2 * k : 2 * k + 2] = later.reshape(-1, nx)
        return z + solved


def _nearest(z: np.ndarray, pinned: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each node with the height of the pinned one nearest to it, the first in row order of equals: what the pins leave open stays there."""
    out, rows = z.copy(), np.array(at).T
    pins = rows[pinned][np.lexsort((at[1][pinned], at[0][pinned]))]
    for part in np.array_split(rows, max(1, len(rows) * len(pins) // 2_000_000)):
        far = ((part[:, None] - pins) ** 2).sum(-1)
        out[tuple(part.T)] = z[tuple(pins[far.argmin(1)].T)]
    return out


def _prolonged(coarse: DataFrame, ny: int, nx: int) -> DataFrame:
    """row, col and z of a frame twice as fine, linear between a coarse frame's nodes."""
    share = F.array(*[F.struct((F.col("row") * 2 + i).alias("row"), (F.col("col") * 2 + j).alias("col"), F.lit((0.75 if i in (0, 1) else 0.25) * (0.75 if j in (0, 1) else 0.25)).alias("w")) for i in range(-1, 3) for j in range(-1, 3)])
    parts = coarse.select("z", F.explode(share).alias("k")).select("z", "k.*").where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1))
    return parts.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def minimum_curvature(
    points: DataFrame, x0: float, y0: float, cell: float, ny: int, nx: int, faults: DataFrame | None = None, tension: float = 0.0, edge_tension: float = 0.0,
    aspect: float = 1.0, tol: float = 1e-4, tile: int = 64, halo: int | None = None, rounds: int = 1000,
) -> DataFrame:
    """row, col and z of the surface through ``points`` (x, y, v): nodes in the middle of cells, row 0 north.

    Nodes with points keep their mean. The rest is where a plate has no bending, or with ``tension`` 1 a membrane; ``edge_tension``
    holds on the frame's edge, ``aspect`` weighs the membrane's pull along columns. Faults (segments x0, y0, x1, y1)
    part nodes on either side exactly. Without a point every z is null.

    The frame is solved coarse to fine: one of a tile's size at once, each finer one from the one before. On a
    finer frame, tiles with ``halo`` nodes around them (three mean distances of nodes with points, at most a tile's side) are solved in
    their own tasks and pass their rims on, until no node moves by ``tol``; tiles that nothing has reached rest. No task ever holds
    more than nine tiles' nodes. Gaps wider than the halo take more rounds.
    """
    pins = snapped(points, x0, y0, cell, ny, nx)
    if pins.isEmpty():
        every = points.sparkSession.range(ny).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("col"))
        return every.withColumn("z", F.lit(None).cast("double"))
    top, level, z = y0 + ny * cell, 0, None
    while max(-(-ny >> level), -(-nx >> level)) > tile:
        level += 1
    while level >= 0:
        k = 1 << level
        h, w = -(-ny // k), -(-nx // k)
        z = _level(points, faults, z, x0, top - h * cell * k, cell * k, h, w, (tension, edge_tension, aspect), tol, tile, halo, rounds)
        level -= 1
    return z


def _level(points: DataFrame, faults: DataFrame | None, coarse: DataFrame | None, x0: float, y0: float, cell: float, ny: int, nx: int, pull: tuple[float, float, float], tol: float, tile: int, halo: int | None, rounds: int) -> DataFrame:
    """row, col and z of one frame, from the frame half as fine or, without one, from the nearest points."""
    pins = snapped(points, x0, y0, cell, ny, nx)
    spark = points.sparkSession
    every = spark.range(ny).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("col"))
    start = every.crossJoin(pins.agg(F.avg("pin").alias("z"))) if coarse is None else _prolonged(coarse, ny, nx)  # one row on the right
    flags = spark.createDataFrame([], "row int, col int, e boolean, s boolean, near boolean") if faults is None else _beside(blocked_edges(faults, x0, y0, cell, ny, nx), ny, nx)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    state = start.join(pins, ["row", "col"], "left").join(flags, ["row", "col"], "left").select("row", "col", F.coalesce("pin", "z").alias("z"), F.col("pin").isNotNull().alias("pinned"), no("e"), no("s"), no("near"), F.lit(float("inf")).alias("moved"))

    names, rough = state.columns, coarse is None
    halo = halo or int(min(tile, max(8, 3 * np.sqrt(ny * nx / pins.count()))))

    def piece(frame: pd.DataFrame, r0: int, c0: int, r1: int, c1: int) -> tuple[Plate, np.ndarray, np.ndarray, tuple]:
        at = (frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0)
        flag = {c: np.zeros((r1 - r0, c1 - c0), bool) for c in ("pinned", "e", "s", "near")}
        z = np.zeros((r1 - r0, c1 - c0))
        z[at] = frame["z"].to_numpy()
        for c, field in flag.items():
            field[at] = frame[c].to_numpy(bool)
        outer = (r0 == 0, r1 == ny, c0 == 0, c1 == nx)
        free = ~flag["pinned"]
        for side, ends in zip((np.s_[:2], np.s_[-2:], np.s_[:, :2], np.s_[:, -2:]), outer, strict=True):
            if not ends:
                free[side] = False  # the rule reaches two nodes further than the piece
        return Plate(z.shape, outer, flag["e"], flag["s"], flag["near"], *pull), z, free, at

    def settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = (frame["row"].to_numpy() // tile == key[0]) & (frame["col"].to_numpy() // tile == key[1])
        if frame["moved"].max() <= tol:  # nothing has come in since this tile settled
            return frame.assign(moved=0.0)[own][names]
        r0, c0 = max(0, key[0] * tile - halo), max(0, key[1] * tile - halo)
        r1, c1 = min(ny, (key[0] + 1) * tile + halo), min(nx, (key[1] + 1) * tile + halo)
        plate, z, free, at = piece(frame, r0, c0, r1, c1)
        if rough and np.isinf(frame["moved"]).all():
            z = _nearest(z, frame["pinned"].to_numpy(bool), at)
        new = plate.solved(z, free)
        return frame.assign(z=new[at], moved=np.abs(new - z)[at])[own][names]

    step: Callable[[DataFrame], DataFrame] = lambda t: tiles(t, tile, halo).groupBy("tr", "tc").applyInPandas(settle, state.schema)
    return fixpoint(state, step, lambda t: t.where(F.col("moved") > tol), rounds).select("row", "col", "z")
