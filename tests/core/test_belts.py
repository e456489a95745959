"""Belts against exact areas, flood-filled counts and known nestings."""

import numpy as np
import pytest

from orogen.operators import belts, raster


def frame(spark, z):
    ny, nx = z.shape
    return spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(ny) for j in range(nx)], "row int, col int, z double"), ny, nx


def faced(spark, z, levels):
    return belts.faces(belts.rings(belts.half_edges(*frame(spark, z), levels)))


def test_areas_are_those_of_the_triangles(spark):
    rng = np.random.default_rng(6)
    z = rng.integers(0, 9, (9, 11)).astype(float)  # many corners at levels
    z[3, 4] = z[0, 0] = z[6, 7] = z[7, 6] = np.nan
    levels = [2.0, 4.0, 5.5, 7.0]
    got = belts.belts(faced(spark, z, levels), levels, 10.0).toPandas()
    above = {r["level"]: r["area"] for r in raster.above_levels(*frame(spark, z), [-1.0, *levels], 10.0).collect()}
    edges = [above[v] for v in (-1.0, *levels)] + [0.0]
    for k in range(5):
        assert got[got["band"] == k]["area"].sum() == pytest.approx(edges[k] - edges[k + 1], abs=1e-6)
    assert (got["area"] > 0).all() and (got["thickness"] == 2 * got["area"] / got["perimeter"]).all()


def test_faces_are_the_connected_parts(spark):
    y, x = np.mgrid[0:25, 0:30]
    z = np.hypot(x - 14.2, y - 12.3)  # rings around a point, cut off by the frame
    z[11:13, 20:22] = np.nan
    levels = [3.05, 6.05, 9.05, 30.0]
    got = belts.belts(faced(spark, z, levels), levels, 1.0).toPandas().set_index("band")
    assert sorted(got.index) == [0, 1, 2, 3]
    assert got.loc[0, "n_holes"] == 0 and got.loc[1, "n_holes"] == 1
    assert got["area"].sum() == pytest.approx(24 * 29 - 9)
    assert got.loc[0, "area"] == pytest.approx(np.pi * 3.05**2, rel=0.04) and got.loc[1, "thickness"] == pytest.approx(3, rel=0.1)
    island = np.zeros((12, 12))
    island[2:10, 2:10] = 5
    island[4:8, 4:8] = 0
    island[5:7, 5:7] = 5
    nested = belts.belts(faced(spark, island, [2.5]), [2.5], 1.0).toPandas()
    assert sorted(zip(nested["band"], nested["n_holes"], strict=True)) == [(0, 1), (0, 1), (1, 0), (1, 1)]
    flat = belts.belts(faced(spark, np.full((4, 5), 3.0), [3.0]), [3.0], 1.0).collect()
    assert [(r["band"], r["area"], r["n_holes"]) for r in flat] == [(1, 12.0, 0)]
    assert belts.half_edges(*frame(spark, np.full((2, 2), np.nan)), [1.0]).count() == 0


def test_belts_that_touch_in_a_node_stay_apart(spark):
    z = np.zeros((5, 5))
    z[0:2, 3:5] = z[3:5, 0:2] = np.nan  # two squares of known ground that meet in the middle centre
    z[2, 3:] = z[3:, 2] = 0
    z[0, 2] = z[1, 2] = z[2, 0] = z[2, 1] = 0
    got = belts.belts(faced(spark, z, []), [], 1.0).collect()
    assert sorted(r["area"] for r in got) == [4.0, 4.0] and all(r["perimeter"] == 8 for r in got)


def test_bands_from_levels(spark):
    touches = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 4.0), (1, 30.0, 0.1), (2, 10.0, 5.0), (2, 30.0, 4.0), (3, 20.0, 9.0), (4, 20.0, 9.0), (6, 99.0, 1.0)], "face int, level double, length double")
    samples = spark.createDataFrame([(1, 3), (2, 3), (3, 0), (4, 3), (5, 2), (6, None)], "face int, sample int")
    got = {r["face"]: (r["band"], r["source"]) for r in belts.bands_from_levels(touches, [10.0, 20.0, 30.0], samples).collect()}
    assert got == {1: (1, "lines"), 2: (3, "sample"), 3: (1, "sample"), 4: (2, "sample"), 5: (2, "sample"), 6: (None, None)}
