"""Figures of one task and of the driver that must not grow with the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import joins, loops
from orogen.operators import breaks, drill, flow, fractal, kriging, lines, points, raster, variogram
from orogen.plans import geometry, queries


def test_composites_are_dealt_by_rows(spark, monkeypatch):
    """Tasks that sort samples and targets grow in number with the samples; a few small bytes don't put them together."""
    monkeypatch.setattr(joins, "_SHARE", 1000, raising=False)
    samples = spark.range(20_000).select(F.floor(F.col("id") / 4).alias("hole_id"), (F.col("id") % 4 * 10.0).alias("frm"), (F.col("id") % 4 * 10.0 + 10).alias("to"), (F.col("id") % 4).cast("double").alias("v"))
    targets = samples.where("frm % 20 = 0").select("hole_id", F.col("frm").alias("t_frm"), (F.col("frm") + 20).alias("t_to"))
    got = drill.composite(samples, targets, ["v"])
    assert got.rdd.getNumPartitions() == 20
    want = {(0.0, 0.5), (20.0, 2.5)}
    assert got.count() == 10_000 and {(r["t_frm"], r["v"]) for r in got.select("t_frm", "v").distinct().collect()} == want
    assert got.where("cover <> 1 or overlap or v_cover <> 1").isEmpty()


def test_bed_grades_keep_the_deal(spark, monkeypatch):
    """Grades of beds are summed where the composites were made, in as many tasks."""
    monkeypatch.setattr(joins, "_SHARE", 1000, raising=False)
    samples = spark.range(20_000).select(F.floor(F.col("id") / 4).alias("hole_id"), (F.col("id") % 4 * 10.0).alias("frm"), (F.col("id") % 4 * 10.0 + 10).alias("to"), (F.col("id") % 4).cast("double").alias("v"))
    targets = samples.select("hole_id", F.col("frm").alias("t_frm"), F.col("to").alias("t_to"), F.when(F.col("frm") < 20, "a").otherwise("b").alias("code"))
    got = drill.bed_grades(drill.composite(samples, targets, ["v"]), ["v"])
    assert got.rdd.getNumPartitions() == 20
    assert {tuple(r) for r in got.drop("hole_id").distinct().collect()} == {("a", 20.0, 0.5), ("b", 20.0, 2.5)} and got.count() == 10_000


def placed(spark, n=4000):
    return spark.range(n).select("id", (F.col("id") % 64 * 32.0).alias("x"), (F.floor(F.col("id") / 64) * 32.0).alias("y"), (F.col("id") % 7).cast("double").alias("v"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detrended_neighbours_are_not_broadcast(spark):
    """Repeats of points in the bins around them aren't sent to the driver."""
    assert "BroadcastHashJoin [_bx" not in plan(kriging.neighbours(placed(spark), placed(spark), 60.0, 12, exclude=True))


def test_estimates_meet_samples_without_broadcast(spark):
    p = placed(spark)
    got = kriging.inverse_distance(p, p, 40.0, exclude=True)
    assert "BroadcastHashJoin" not in plan(got)
    assert points.validation(got.join(p, "id"), "v", "estimate").first()["n"] == 4000


def test_near_pairs_past_faults_stay_in_their_bins(spark):
    """Neither pairs nor faults are broadcast, and pairs that bring their bins are not shuffled for the faults."""
    p = placed(spark).select("id", "x", "y")
    faults = spark.createDataFrame([(16.0, -50.0, 16.0, 5000.0)], "x0 double, y0 double, x1 double, y1 double")
    pairs = kriging.near_join(p, p, 40.0, keep=True).where("l_id <> r_id")
    got = kriging.blocked(pairs, faults, 40.0)
    assert "BroadcastHashJoin" not in plan(got) and plan(got).count("Exchange hashpartitioning(_bx") == 3
    want = pairs.where("(l_x < 16) = (r_x < 16)").count()
    assert got.count() == want == kriging.blocked(pairs.drop("_bx", "_by"), faults, 40.0).count()


def test_near_pairs_are_dealt_by_rows(spark, monkeypatch):
    """Tasks of a distance join grow in number with the points; a crowded bin is left to Spark."""
    monkeypatch.setattr(joins, "_SHARE", 1000, raising=False)
    p = placed(spark)
    got = variogram.pairs_within(p, 40.0)
    assert got.rdd.getNumPartitions() == 40 and got.count() == 4000 - 63 + 4000 - 64
    crowd = joins.near_join(p.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)).limit(50), p.limit(50), 40.0)
    assert "REPARTITION" not in plan(crowd) and crowd.count() == 100
    assert [r["gamma"] for r in variogram.nugget_pairs(p, 40.0).collect()] == [18.0] * 5


def test_cells_of_samples_are_dealt(spark, monkeypatch):
    """Distinct cells are held by tasks that grow in number with the samples; places that repeat and empty ones count as before."""
    monkeypatch.setattr(joins, "_SHARE", 1000, raising=False)
    p = placed(spark).select("x", "y")
    got = fractal.minkowski_counts(p.union(p).union(spark.createDataFrame([(None, None)], p.schema)), [32.0, 64.0], [(0.0, 0.0), (0.5, 0.5)])
    assert plan(got).count("REPARTITION_BY_NUM") == 2
    assert {r["size"]: r["n"] for r in got.collect()} == {32.0: 4001, 64.0: 31 * 32 + 16 + 1}


def test_frames_and_rasters_are_dealt(spark, monkeypatch, tmp_path):
    """A raster's cells are averaged by tasks that grow in number with the orders, and a filtered frame isn't broadcast."""
    monkeypatch.setattr(joins, "_SHARE", 1000, raising=False)
    spark.range(6000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.col("id").cast("double").alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    cells = geometry.raster(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() == 6
    ny, nx = raster.frame(cells)
    high = raster.dense(cells, ny, nx).where("z > 2")
    assert "BroadcastHashJoin" not in plan(high) and high.count() == cells.where("z > 2").count() > 0


def waves(spark, ny=24, nx=40):
    """A dense raster whose heights rise and fall over many tiles of a few cells."""
    r, c = F.col("id") / nx, F.col("id") % nx
    return spark.range(ny * nx).select(F.floor(r).cast("int").alias("row"), c.cast("int").alias("col"), (F.sin(F.floor(r) / 3.0) * 20 + F.cos(c / 5.0) * 20 + F.col("id") * 7919 % 13).alias("z")), ny, nx


def test_bridges_share_tasks(spark, monkeypatch):
    """Patches of a mask are worked on in lots, not each in a group of its own; lots don't show."""
    cells, ny, nx = waves(spark)
    mask = cells.where("z > 18").select("row", "col")
    got = []
    for lot in (10, 100_000):
        monkeypatch.setattr(raster, "_LOT", lot, raising=False)
        new = raster.bridges_removed(cells, mask, ny, nx)
        assert "FlatMapGroupsInPandas [lot" in plan(new)
        got.append({tuple(r) for r in new.collect()})
    assert got[0] == got[1] and len(got[0]) == ny * nx and got[0] != {tuple(r) for r in cells.collect()}


def test_quartiles_of_rings_are_numpys():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 10, 33):
        v = np.sort(rng.normal(size=n))
        assert all(raster._percentile(v, q) == np.percentile(v, q) for q in (0.0, 25.0, 60.0, 100.0))
    assert np.isnan(raster._percentile(np.array([1.0, np.nan]), 25.0))


def test_filling_ends_when_no_rim_was_lowered(spark, monkeypatch):
    """Cells lowered inside a tile are no news to others: one tile is settled in one round, and tiles of any size give the same surface."""
    cells, ny, nx = waves(spark)
    steps = []

    def counted(df, step, changed, rounds=64):
        return loops.fixpoint(df, lambda t: steps.append(1) or step(t), changed, rounds)

    monkeypatch.setattr(flow, "fixpoint", counted)
    whole = {tuple(r) for r in flow.fill(cells, ny, nx).collect()}
    assert len(steps) == 1 and len(whole) == ny * nx
    assert {tuple(r) for r in flow.fill(cells, ny, nx, tile=7).collect()} == whole


def test_contours_are_followed_by_tiles(spark, monkeypatch):
    """Rounds are over stretches between tiles, not over all pieces; tiles don't show."""
    cells, ny, nx = waves(spark)
    pieces = raster.contour_segments(cells, ny, nx, [0.0, 12.0])
    seen = []
    monkeypatch.setattr(lines, "climb", lambda t: seen.append(t.count()) or flow.climb(t))
    got = [{tuple(r) for r in lines.contour_polylines(pieces, **tile).select("level", "line", "seq", "x", "y", "closed").collect()} for tile in ({}, {"tile": 6})]
    assert got[0] == got[1] and max(seen) < pieces.count() / 2


def test_streams_are_followed_by_tiles(spark, monkeypatch):
    """Links, catchments and main streams don't jump over all cells in rounds; what tiles find is what pointers find."""
    cells, ny, nx = waves(spark)
    down = loops.checkpointed(flow.receivers(cells, ny, nx))
    acc = loops.checkpointed(flow.accumulation(down, nx))
    seeds = acc.where("acc >= 12").join(down.where("down is null"), "cell").select("cell")
    rows = lambda t: {tuple(r) for r in t.collect()}
    streams = acc.where("acc >= 3")
    want = rows(flow.strahler(down, streams)), rows(flow.catchments(down, seeds)), rows(flow.stream_cells(down, acc, 3))
    monkeypatch.setattr(flow, "climb", None)
    assert (rows(flow.strahler(down, streams, nx)), rows(flow.catchments(down, seeds, nx)), rows(flow.stream_cells(down, acc, 3, nx, tile=5))) == want
    ways = rows(flow.main_streams(down, acc, seeds, nx, tile=5))
    assert ways == rows(flow.main_streams(down, acc, seeds, nx)) and len({r[0] for r in ways}) == seeds.count()


def test_break_lines_are_traced_by_tiles(spark, monkeypatch):
    """Rounds are over stretches of a skeleton between tiles, not over all its steps; tiles don't show."""
    skeleton = spark.range(200).select(F.floor(10 + 8 * F.sin(F.col("id") / 20.0)).cast("int").alias("row"), F.col("id").cast("int").alias("col"))
    seen = []
    monkeypatch.setattr(lines, "climb", lambda t: seen.append(t.count()) or flow.climb(t))
    got = [sorted(tuple(r) for r in breaks.traced(skeleton, 200, **tile).collect()) for tile in ({}, {"tile": 16})]
    assert got[0] == got[1] and len(got[0]) == 200 and max(seen) < 100


def test_bridges_are_not_broadcast(spark):
    """Neither a mask's patches nor the ground or the lowered heights go through the driver."""
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") % 20 == 9, 5.0).otherwise(1.0).alias("z"))
    held, plain = [], raster.checkpointed
    with pytest.MonkeyPatch.context() as m:
        m.setattr(raster, "checkpointed", lambda t: held.append(plan(t)) or plain(t))
        got = raster.bridges_removed(cells, cells.where("z > 2").select("row", "col"), 20, 20)
    assert "BroadcastHashJoin" not in held[-1].replace("BroadcastHashJoin [label", "") and "BroadcastHashJoin" not in plan(got)
    assert got.where("z = 1").count() == 400


def test_lags_of_very_many_pairs(spark):
    """The square of a lag's pairs is more than a long holds from 3 billion pairs on."""
    n = 10_000_000_000
    sums = spark.createDataFrame([(0, n, 1.0 * n, 30.0 * n, 8.0 * n, 2.0 * n), (1, 4, 4.0, 20.0, 16.0, 4.0)], "bin int, npairs long, w double, h double, d2 double, root double")
    far, near = variogram.lag_means(sums).orderBy("bin").collect()
    assert (far["npairs"], far["lag"], far["gamma"]) == (n, 30.0, 4.0) and abs(far["gamma_robust"] - 8 / 0.457) < 1e-8
    assert near["gamma_robust"] == 0.5 / (0.457 + 0.494 / 4 + 0.045 / 16)


def test_most_nodes_of_the_simulation_are_drawn(spark, monkeypatch):
    """Samples fix a fifth of the nodes; the others differ between realisations."""
    held, plain = [], kriging.simulate
    monkeypatch.setattr(kriging, "simulate", lambda *a, **b: held.append(plain(*a, **b)) or held[0])
    rows = queries.gaussian_simulation(spark, "/root/testdata/sf0.001").collect()
    nodes = held[0].groupBy("row", "col").agg(F.count("*").alias("n"), F.count_distinct("score").alias("drawn")).collect()
    assert all(r["n"] == 4 for r in nodes) and len(nodes) == 16 * len(rows)
    assert 0.7 < sum(r["drawn"] == 4 for r in nodes) / len(nodes) < 0.9


def test_paths_are_drawn_one_by_one(spark):
    """Nodes solved many at a time have the scores of nodes solved one after the other, with few samples and with many."""
    model, ny, nx = kriging.Model("spherical", 1.0, 4.0), 9, 11
    for fixed in ({(2, 3): 1.5}, {(i, j): float((i * 7 + j * 3) % 5) - 2 for i in range(ny) for j in range(nx) if (i + 2 * j) % 4 == 0}):
        known = spark.createDataFrame([(float(j), float(i), v) for (i, j), v in fixed.items()], "x double, y double, v double")
        got = {(r["row"], r["col"]): r["score"] for r in kriging.simulate(known, model, 0.0, 0.0, 1.0, ny, nx, 1, most=5, window=3).collect()}
        rng, z = np.random.default_rng((1, 0, 0, 0)), dict(fixed)
        for k in rng.permutation(np.arange(ny * nx)).tolist():
            i, j = divmod(k, nx)
            if (i, j) in z:
                continue
            near = sorted(((a - i) ** 2 + (b - j) ** 2, a, b) for a, b in z if abs(a - i) <= 3 and abs(b - j) <= 3)[:5]
            e, s = 0.0, model.top
            if near:
                _, a, b = np.array(near, float).T
                (e,), (s,) = kriging.solve(np.array([float(j)]), np.array([float(i)]), b[None], a[None], np.array([[z[p[1:]] for p in near]]), model, 0.0)
            z[i, j] = e + rng.normal() * np.sqrt(s)
        assert got.keys() == z.keys() and max(abs(got[p] - z[p]) for p in z) < 1e-9
