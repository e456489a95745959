"""Minimum curvature against a dense solve, planes, and faults."""

import numpy as np
import pytest

from orogen.operators import curvature


def table(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, v double")


def solved(frame, ny, nx):
    z = np.full((ny, nx), np.nan)
    for r in frame.collect():
        z[r["row"], r["col"]] = r["z"]
    return z


def dense(pins, ny, nx, tension=0.0):
    """The thin plate by one matrix: a ghost node is its two neighbours inside, carried on straight."""
    index, a, b = np.arange(ny * nx).reshape(ny, nx), np.zeros((ny * nx, ny * nx)), np.zeros(ny * nx)

    def add(row, i, j, w):
        for axis, n in ((0, ny), (1, nx)):
            k = (i, j)[axis]
            if not 0 <= k < n:
                d, edge, inner = (-k, 0, 1) if k < 0 else (k - n + 1, n - 1, n - 2)
                for at, share in ((edge, d + 1), (inner, -d)):
                    add(row, *((at, j) if axis == 0 else (i, at)), w * share)
                return
        a[row, index[i, j]] += w

    for i, j in np.ndindex(ny, nx):
        k = index[i, j]
        a[k, k] = 1.0
        if (i, j) in pins:
            b[k] = pins[i, j]
            continue
        for (di, dj), w in {(0, 1): 8, (0, -1): 8, (1, 0): 8, (-1, 0): 8, (1, 1): -2, (1, -1): -2, (-1, 1): -2, (-1, -1): -2, (2, 0): -1, (-2, 0): -1, (0, 2): -1, (0, -2): -1}.items():
            add(k, i + di, j + dj, -(1 - tension) * w / 20)
            if abs(di) + abs(dj) == 1:
                add(k, i + di, j + dj, -tension / 4)
    return np.linalg.solve(a, b).reshape(ny, nx)


@pytest.mark.parametrize("tension,tile", [(0.0, 40), (0.35, 18)])
def test_equals_a_dense_solve_whatever_the_tiles(spark, tension, tile):
    rng = np.random.default_rng(3)
    ny, nx, cell = 26, 31, 10.0
    at = [tuple(x) for x in np.argwhere(rng.random((ny, nx)) < 0.05)]
    pins = {p: float(rng.normal(0, 5)) for p in at}
    points = [(5.0 + c * cell + s, (ny - r) * cell - 5.0, v + s) for (r, c), v in pins.items() for s in (-1.0, 1.0)]
    got = curvature.minimum_curvature(table(spark, points), 0.0, 0.0, cell, ny, nx, tension=tension, tol=1e-5, tile=tile)
    assert np.abs(solved(got, ny, nx) - dense(pins, ny, nx, tension)).max() < 1e-3


def test_planes_stay_planes_and_few_points_are_enough(spark):
    plane = lambda x, y: 3 + 0.2 * x - 0.1 * y
    points = [(x, y, plane(x, y)) for x, y in ((5, 5), (395, 15), (205, 355), (15, 385), (385, 395), (145, 155))]
    z = solved(curvature.minimum_curvature(table(spark, points), 0.0, 0.0, 10.0, 40, 40, tol=1e-5, tile=24), 40, 40)
    x, y = np.meshgrid(np.arange(40) * 10.0 + 5, 395 - np.arange(40) * 10.0)
    assert np.abs(z - plane(x, y)).max() < 1e-3
    one = solved(curvature.minimum_curvature(table(spark, [(50, 50, 7)]), 0.0, 0.0, 10.0, 10, 10), 10, 10)
    assert np.abs(one - 7).max() < 1e-6
    none = curvature.minimum_curvature(table(spark, []), 0.0, 0.0, 10.0, 4, 5)
    assert none.count() == 20 and none.where("z is not null").count() == 0


def test_faults_part_two_plateaus(spark):
    rng = np.random.default_rng(1)
    points = [(x, y, 0.0 if x < 200 else 10.0) for x, y in rng.uniform(0, 400, (60, 2))]
    fault = spark.createDataFrame([(200.0, -10.0, 200.0, 410.0)], "x0 double, y0 double, x1 double, y1 double")
    cut = solved(curvature.minimum_curvature(table(spark, points), 0.0, 0.0, 10.0, 40, 40, fault, tension=1.0, tol=1e-5, tile=24), 40, 40)
    assert np.abs(cut[:, :20]).max() < 1e-3 and np.abs(cut[:, 20:] - 10).max() < 1e-3
    whole = solved(curvature.minimum_curvature(table(spark, points), 0.0, 0.0, 10.0, 40, 40, tension=1.0), 40, 40)
    assert (np.abs(np.diff(whole, axis=1)) < 9).all() and whole[:, 19].max() > 0.5


def test_blocked_edges_equal_segment_tests(spark):
    rng = np.random.default_rng(2)
    segments = [tuple(map(float, s)) for s in rng.uniform(-30, 130, (12, 4))] + [(5.0, 5.0, 95.0, 95.0), (45.0, -5.0, 45.0, 105.0), (0.0, 55.0, 100.0, 55.0)]
    got = {(r["row"], r["col"]): (r["e"], r["s"]) for r in curvature.blocked_edges(spark.createDataFrame(segments, "x0 double, y0 double, x1 double, y1 double"), 0.0, 0.0, 10.0, 10, 10).collect()}

    def left(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0

    def cross(p, q):
        return any(left(s[:2], s[2:], p) != left(s[:2], s[2:], q) and left(p, q, s[:2]) != left(p, q, s[2:]) for s in segments)

    at = lambda r, c: (c * 10.0 + 5, 95 - r * 10.0)
    want = {(r, c): (c < 9 and cross(at(r, c), at(r, c + 1)), r < 9 and cross(at(r, c), at(r + 1, c))) for r in range(10) for c in range(10)}
    assert got == {k: v for k, v in want.items() if any(v)}
