"""Smoothing that keeps edges, burned channels, outline catchments and floods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.operators import burning, flow, smoothing
from tests.core.test_belts import frame
from tests.core.test_breaks import mask_of


def heights(frame, shape):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    return out


def test_smoothing_keeps_planes_and_crests_and_shows_no_tiles(spark):
    y, x = np.mgrid[0:40, 0:46]
    rng = np.random.default_rng(2)
    ridge = 20 - np.abs(x - 22) * 0.8 + y * 0.05
    rough = ridge + rng.normal(0, 0.05, ridge.shape)
    rough[7, 30] = np.nan
    cells, ny, nx = frame(spark, rough)
    whole = heights(smoothing.feature_preserving(cells, ny, nx, 1.0, passes=2, size=5, tile=64), ridge.shape)
    tiled = heights(smoothing.feature_preserving(cells, ny, nx, 1.0, passes=2, size=5, tile=13), ridge.shape)
    assert np.isnan(whole[7, 30]) and np.allclose(whole, tiled, equal_nan=True, atol=1e-12)
    inner = np.s_[3:-3, 3:-3]
    left = np.nanstd((whole - ridge)[inner])
    assert left < 0.85 * 0.05 and np.nanmax(np.abs(whole - ridge)[:, 21:24][3:-3]) < 0.3
    plane = heights(smoothing.feature_preserving(*frame(spark, 0.3 * x - 0.2 * y + 5.0), 1.0, turns=1), ridge.shape)
    assert np.abs(plane - (0.3 * x - 0.2 * y + 5.0))[1:-1, 1:-1].max() < 1e-9  # ends repeat, so the outermost cells give way


def test_burned_channels_fall_all_the_way(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(10, 12, (20, 24)) - np.arange(24) * 0.01
    z[5, 9] = np.nan
    line = spark.createDataFrame([(1, 0, 0.5, 14.5), (1, 1, 12.0, 14.5), (1, 2, 23.5, 4.2), (2, 0, -5.0, 3.0), (2, 1, 40.0, 3.0)], "line int, seq int, x double, y double")
    cells, ny, nx = frame(spark, z)
    passed = burning.along(line, 0.0, 20.0, 1.0, ny, nx).cache()
    order = [(r["row"], r["col"]) for r in passed.where("line = 1").orderBy("k").collect()]
    assert order[0] == (5, 0) and order[-1] == (15, 23) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(order, order[1:], strict=False))
    assert [(r["row"], r["col"]) for r in passed.where("line = 2").orderBy("k").collect()] == [(17, c) for c in range(24)]
    flat = heights(burning.burned(cells, passed, 2.0), z.shape)
    assert flat[5, 3] == pytest.approx(z[5, 3] - 2) and np.isnan(flat[5, 9]) and flat[0, 0] == z[0, 0]
    cut = heights(burning.burned(cells, passed.where("line = 1"), 2.0, 0.001, 1.0), z.shape)
    bed = [cut[p] for p in order if np.isfinite(z[p])]
    low = [z[p] - 2 for p in order if np.isfinite(z[p])]
    if low[0] < low[-1]:
        bed, low = bed[::-1], low[::-1]
    want = [low[0]]
    for v in low[1:]:
        want.append(min(v, want[-1] - 0.001))
    assert bed == pytest.approx(want, abs=1e-9)
    ground = np.add.outer(np.zeros(20), np.abs(np.arange(24) - 12)) + 1.0 + np.arange(20)[:, None] * 0.001
    table, ny, nx = frame(spark, ground)
    down = flow.receivers(table, ny, nx)
    seeds = burning.outlined(spark.createDataFrame([(1, 0, 11.2, 18.8), (1, 1, 13.8, 18.8), (1, 2, 13.8, 1.2), (1, 3, 11.2, 1.2)], "line int, seq int, x double, y double"), 0.0, 20.0, 1.0, ny, nx)
    got = {(r["row"], r["col"]) for r in seeds.collect()}
    assert got == {(r, c) for r in range(1, 19) for c in (11, 12, 13)}
    told = burning.trace_report(table, down, seeds, nx, 10.0).first()
    assert told["trace_cells"] == 54 and told["cells"] > 400 and told["area_km2"] == pytest.approx(told["cells"] * 1e-4) and told["slope_mean"] is None


def test_floods_reach_what_hangs_together(spark):
    z = np.full((9, 12), 5.0)
    z[4, :] = 1.0  # a channel
    z[5, 3] = z[6, 4] = 2.0  # reached over a corner
    z[1, 8] = 0.0  # low, but cut off
    cells, ny, nx = frame(spark, z)
    places = spark.createDataFrame([(0, float(c), r, c) for r in range(9) for c in range(12)], "key int, s double, row int, col int")
    sections = spark.createDataFrame([(0, 2.0, 3.0), (0, 10.0, 1.0)], "key int, s double, level double")
    levels = burning.water_surface(places, sections).select("row", "col", "level").cache()
    at = {(r["row"], r["col"]): r["level"] for r in levels.collect()}
    assert at[0, 0] == 3 and at[0, 2] == 3 and at[0, 6] == pytest.approx(2) and at[0, 11] == 1
    got = burning.flooded(cells, levels, cells.where("row = 4"), ny, nx)
    wet = mask_of(got, z.shape)
    assert {tuple(map(int, p)) for p in np.argwhere(wet)} == {(4, c) for c in range(10)} | {(5, 3), (6, 4)}
    assert {(r["row"], r["col"]): r["depth"] for r in got.collect()}[5, 3] == pytest.approx(0.75)


def test_cells_of_few_vertices_are_not_broadcast(spark):
    """Two vertices pass some 600 cells: what joins with them goes by the cells' size, not the vertices'."""
    ny = nx = 600
    line = spark.range(2).select(F.lit(0).alias("line"), F.col("id").alias("seq"), (F.col("id") * 5985.0 + 5).alias("x"), (F.col("id") * 5980.0 + 5).alias("y"))
    cells = spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"), F.lit(7.0).alias("z"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        passed = burning.along(line, 0.0, ny * 10.0, 10.0, ny, nx)
        plan = passed.join(cells, ["row", "col"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        got = burning.burned(cells, passed, 5.0, 0.02, 10.0).where("z < 7")
        assert got.count() == passed.count() > 590
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
