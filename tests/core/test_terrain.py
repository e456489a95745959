"""Terrain with streams and lakes."""

import numpy as np
import pytest

from orogen.operators import burning, terrain


def test_streams_fall_and_lakes_are_level(spark):
    rng = np.random.default_rng(8)
    n, cell = 30, 10.0
    points = spark.createDataFrame([(float(x), float(y), float(20 + 0.05 * y + rng.normal(0, 2))) for x, y in rng.uniform(0, 300, (90, 2))], "x double, y double, v double")
    streams = spark.createDataFrame([(1, 0, 155.0, 295.0), (1, 1, 140.0, 5.0), (2, 0, 20.0, 250.0), (2, 1, 147.0, 130.0)], "line int, seq int, x double, y double")
    lakes = spark.createDataFrame([(7, k, x, y, None) for k, (x, y) in enumerate(((210.0, 60.0), (260.0, 60.0), (260.0, 110.0), (210.0, 110.0)))], "line int, seq int, x double, y double, level double")
    found = {}
    for tile in (64, 17):
        got = terrain.surface(points, 0.0, 0.0, cell, n, n, streams, lakes, tol=1e-6, tile=tile).collect()
        assert len(got) == n * n
        found[tile] = {(r["row"], r["col"]): (r["z"], r["kind"]) for r in got}
    assert max(abs(found[64][p][0] - found[17][p][0]) for p in found[64]) < 1e-2
    z = found[64]
    lake = {round(v, 9) for v, kind in z.values() if kind == "lake"}
    assert len(lake) == 1
    for line in (1, 2):
        cells = [(r["row"], r["col"]) for r in burning.along(streams.where(f"line = {line}"), 0.0, 300.0, cell, n, n).orderBy("k").collect()]
        bed = [z[p][0] for p in cells]
        assert all(b <= a - 0.01 + 1e-9 for a, b in zip(bed, bed[1:], strict=False)) and all(z[p][1] == "stream" for p in cells)


def test_beds_keep_anchors_and_meet(spark):
    rows = [(1, k, 0, k) for k in range(8)] + [(2, 0, 2, 5), (2, 1, 1, 5), (2, 2, 0, 5)]
    passed = spark.createDataFrame(rows, "line int, k long, row int, col int")
    ground = spark.createDataFrame([(0, c, z) for c, z in enumerate((9.0, 9.5, 3.0, 8.0, 8.0, 7.0, 6.0, 9.0))] + [(1, 5, 2.0), (2, 5, 9.0)], "row int, col int, z double")
    anchors = spark.createDataFrame([(0, 1, 8.0), (0, 3, 7.0), (0, 6, 7.5)], "row int, col int, pin double")
    bed = {(r["line"], r["k"]): r["bed"] for r in terrain.stream_beds(passed, ground, anchors, 0.1).collect()}
    one = [bed[1, k] for k in range(8)]
    assert one[1] == pytest.approx(8.0) and 7.0 <= one[2] <= 7.9 and one[3] == pytest.approx(7.0)  # the floor of the anchor below lifts the hole
    assert one[5] == pytest.approx(bed[2, 2]) and one[5] <= 1.9 + 1e-9 and all(b <= a - 0.1 + 1e-9 for a, b in zip(one, one[1:], strict=False))
