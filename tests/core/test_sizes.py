"""What larger tables bring: sizes beyond the SQL's, and work that grows with the rows."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orogen.functions.joins import block_pairs
from orogen.operators import flow, lines, section, variogram
from orogen.plans.queries import ORACLES, QUERIES


def test_box_sizes_of_a_large_raster(spark, tmp_path):
    keys = spark.range(300).select((F.col("id") * 22_000).alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit(200_000.0).alias("o_totalprice"))
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = QUERIES["box_counting"](spark, str(tmp_path)).collect()
    assert sorted((r["size"], r["n"]) for r in got) == sorted(con.execute(ORACLES["box_counting"]).fetchall())


def test_nearest_segments_meet_few(spark):
    """Points near and far from lines with short and long segments, ties and doubled vertices, against all segments."""
    rng = np.random.default_rng(5)
    ver = [(k, i, float(x), float(y)) for k in (0, 1) for i, (x, y) in enumerate(zip(rng.integers(0, 400, 60), rng.integers(0, 30, 60), strict=True))]
    ver += [(0, 60, 5000.0, 0.0), (0, 61, 5000.0, 0.0), (2, 0, 7.0, 7.0), (2, 1, 7.0, 7.0)]
    pts = [(i, i % 4, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(-50, 450, 400), rng.integers(-50, 80, 400), strict=True))]
    pts += [(900, 0, 1e6, -1e6), (901, 1, None, 1.0), (None, 0, 3.0, 4.0), (902, 1, -3000.0, 10.0)]
    vertices = spark.createDataFrame(ver, "line int, seq long, x double, y double")
    points = spark.createDataFrame(pts, "id long, line int, x double, y double")
    segs = {k: [(a, b) for a, b in zip([v for v in ver if v[0] == k], [v for v in ver if v[0] == k][1:], strict=False)] for k in (0, 1, 2)}
    want = {}
    for i, k, x, y in pts:
        if k == 3 or x is None:
            continue
        best = []
        for (_, s, ax, ay), (_, _, bx, by) in segs[k]:
            n = np.hypot(bx - ax, by - ay)
            t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n**2)) if n else 0.0
            ex, ey = x - ax - t * (bx - ax), y - ay - t * (by - ay)
            best.append((np.hypot(ex, ey), s, n > 0))
        want[i] = (k, min(best)[0], min((b for b in best if b[2]), default=(None,))[0])
    got = {r["id"]: r for r in section.project(points, vertices).collect()}
    assert set(got) == set(want) | {901} and got[901]["offset"] is None
    assert all(got[i]["line"] == k and abs(got[i]["offset"] - d) < 1e-9 * (1 + d) for i, (k, d, _) in want.items())
    got = {r["id"]: r for r in lines.station_offsets(points, vertices).collect()}
    assert set(got) == {i for i, w in want.items() if w[2] is not None} | {901}
    assert all(abs(abs(got[i]["offset"]) - d) < 1e-9 * (1 + d) for i, (_, _, d) in want.items() if d is not None)


def test_nearest_segments_meet_no_whole_line(spark):
    """A point meets the segments around it, not all of its line."""
    n = 4000
    vertices = spark.range(n).select(F.lit(0).alias("line"), F.col("id").alias("seq"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    points = spark.range(n).select("id", F.lit(0).alias("line"), (F.col("id") * 10.0 + 3).alias("px"), F.lit(2.0).alias("py"))

    def told(g):
        away = F.abs(F.col("px") - g["x0"])
        return F.struct(F.when(away > 1000, F.raise_error(F.lit("far")).cast("double")).otherwise(away).alias("away"), g["seq"].alias("seq"))

    assert section.nearest_segments(points, section.segments(vertices), told).where("b.away > 7").count() <= 1  # the last point


def test_pairs_are_met_in_small_squares(spark):
    """Kernels get points that lie near one another, whole blocks only if those are small; sums equal those over all pairs, weighted too."""
    rng = np.random.default_rng(6)
    n, reach = 3000, 400.0
    x, y, v, w = rng.integers(0, 1000, n).astype(float), rng.integers(0, 1000, n).astype(float), rng.normal(0, 1, n), rng.uniform(0.5, 2, n)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "v": v, "w": w}))

    def size(left, right, mask):
        return pd.DataFrame({"n": [max(len(left[0]), len(right[0]))]})

    assert block_pairs(rows, reach, ["x", "y"], size, "n long").agg(F.max("n")).first()[0] <= 320
    i, j = np.triu_indices(n, 1)
    h, d = np.hypot(x[j] - x[i], y[j] - y[i]), v[j] - v[i]
    for weighted in (False, True):
        k = w[i] * w[j] if weighted else np.ones(len(i))
        samples = rows if weighted else rows.drop("w")
        got = {r["bin"]: r for r in variogram.experimental(samples, 8, reach).collect()}
        keep = (h > 0) & (h <= reach)
        at = np.minimum(np.floor(h / (reach / 8)), 7).astype(int)
        for b in range(8):
            m = keep & (at == b)
            assert got[b]["npairs"] == m.sum() and np.isclose(got[b]["lag"], np.average(h[m], weights=k[m])) and np.isclose(got[b]["gamma"], 0.5 * np.average(d[m] ** 2, weights=k[m]))
            mean = np.average(np.sqrt(np.abs(d[m])), weights=k[m])
            assert np.isclose(got[b]["gamma_robust"], 0.5 * mean**4 / (0.457 + 0.494 / m.sum() + 0.045 / m.sum() ** 2))
        ix, iy = (np.concatenate((np.rint(c / 80), -np.rint(c / 80))).astype(int) for c in (x[j] - x[i], y[j] - y[i]))
        grid = {(r["ix"], r["iy"]): r for r in variogram.surface(samples, 5, reach).collect()}
        for a, b in ((0, 1), (5, 5), (-3, 2), (-5, -1)):
            m = (ix == a) & (iy == b)
            assert grid[a, b]["npairs"] == m.sum() and np.isclose(grid[a, b]["gamma"], np.average(np.tile(0.5 * d * d, 2)[m], weights=np.tile(k, 2)[m]))


def test_stations_meet_few_segments(spark):
    """A station meets the segments around it, not all of its line: with 4,000 of both, some 12,000 pairs and no 16,000,000."""
    n = 4000
    vertices = spark.range(n).select(F.lit(0).alias("line"), F.col("id").alias("seq"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    asked = spark.range(n).select("id", F.lit(0).alias("line"), (F.col("id") * 10.0 - 10).alias("sta"), F.lit(2.0).alias("offset"))
    got = lines.at_stations(vertices, asked)
    keys = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bin" in keys and got.where("x = id * 10 - 10 and y = -2").count() == n


def test_windows_around_points_are_not_broadcast(spark):
    """A few points' windows are many rows, which estimates from the points don't tell."""
    points = spark.range(50).select("id", F.col("id").cast("int").alias("row"), F.col("id").cast("int").alias("col"))
    acc = spark.range(10_000).select(F.col("id").alias("cell"), (F.col("id") % 77).alias("acc"))
    got = flow.snap(points, acc, 100, 100, 3)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = min((-(c % 77), c) for c in (r * 100 + k for r in range(7, 14) for k in range(7, 14)))[1]
    assert got.where("id = 10").first()["cell"] == want and got.count() == 50
