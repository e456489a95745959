"""Spatial operators against closed forms and brute force."""

import heapq
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import scalar
from orogen.functions.joins import near_join
from orogen.operators import density, drill, flow, fractal, kriging, points, raster, section, variogram
from orogen.plans import geometry, queries
from orogen.sources import tables
from orogen.streaming import density as stream


def cells_of(spark, z):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(np.asarray(z, float))]
    return spark.createDataFrame(rows, "row int, col int, z double"), *np.shape(z)


def grid_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(np.sin(x / 20) + y / 50)) for i, (x, y) in enumerate(rng.uniform(0, 100, (120, 2)))]
    return spark.createDataFrame(rows, "id long, x double, y double, v double")


def test_near_join_finds_all_pairs(sample):
    p = np.array([(r["x"], r["y"]) for r in sample.collect()])
    d = np.hypot(*(p[:, None] - p).transpose(2, 0, 1))
    assert near_join(sample, sample, 13.0).count() == int((d <= 13.0).sum())


def test_variogram_of_a_plane(spark):
    plane = spark.createDataFrame([(i * 10 + j, float(i), float(j), 2.0 * i) for i in range(10) for j in range(10)], "id long, x double, y double, v double")
    got = {r["ix"]: r["gamma"] for r in variogram.surface(plane, 3, 3.0, 1).where("iy = 0").collect()}
    assert got[0] == 0 and got[1] == pytest.approx(2.0) and got[2] == pytest.approx(8.0) == got[-2]
    lag, reach = np.linspace(5, 100, 12), 60.0
    gamma = 0.5 + 3 * np.where(lag < reach, 1.5 * lag / reach - 0.5 * (lag / reach) ** 3, 1)
    fitted = variogram.fit(lag, gamma, np.full(12, 50.0))
    assert fitted["kind"] == "spherical" and fitted["range"] == pytest.approx(reach, rel=0.02) and fitted["nugget"] == pytest.approx(0.5, abs=0.05)


def test_rows_in_any_partitions_give_the_same(sample):
    want = sorted(map(tuple, variogram.experimental(sample).select("bin", "npairs").collect()))
    for n in (1, 7):
        assert sorted(map(tuple, variogram.experimental(sample.repartition(n)).select("bin", "npairs").collect())) == want


def test_kriging_is_exact_and_unbiased(spark, sample):
    model = kriging.Model("spherical", 1.0, 60.0, 0.1)
    at = {r["id"]: r for r in kriging.krige(sample.select("id", "x", "y"), sample, model, 40.0).collect()}
    for r in sample.collect():
        assert at[r["id"]]["estimate"] == pytest.approx(r["v"]) and at[r["id"]]["variance"] == 0
    flat = sample.withColumn("v", F.lit(7.0))
    targets = spark.createDataFrame([(k, 10.0 * k + 3, 55.0) for k in range(9)], "id long, x double, y double")
    for r in kriging.krige(targets, flat, model, 60.0).collect():
        assert r["estimate"] == pytest.approx(7.0) and r["variance"] > 0
    for r in kriging.krige(targets, sample, model, 60.0, block=10.0, grid=3).collect():
        assert r["variance"] < model.top
    assert kriging.krige(targets, sample.limit(2), model, 500.0).where("estimate is not null").count() == 0
    shuffled = kriging.krige(targets, sample.orderBy(F.rand(1)), model, 60.0, most=6).orderBy("id").collect()
    assert [r["estimate"] for r in shuffled] == pytest.approx([r["estimate"] for r in kriging.krige(targets, sample, model, 60.0, most=6).orderBy("id").collect()])


def test_simulation_honours_samples(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0, 1.5), (2, 3.0, 4.0, -0.5)], "id long, x double, y double, v double")
    got = kriging.simulate(known, kriging.Model("spherical", 1.0, 5.0), 0.0, 0.0, 1.0, 6, 6, 3)
    assert got.count() == 108 and got.where("row = 0 and col = 0").select("score").distinct().collect()[0][0] == 1.5
    assert got.where("row = 4 and col = 3").select("score").distinct().count() == 1


def test_simulation_keeps_samples_beyond_the_edge(spark):
    known = spark.createDataFrame([(5.8, 2.0, 2.5), (-3.0, 0.0, -0.5)], "x double, y double, v double")
    got = kriging.simulate(known, kriging.Model("spherical", 1.0, 5.0), 0.0, 0.0, 1.0, 6, 6, 3)
    fixed = {tuple(r) for r in got.where("row = 2 and col = 5 or row = 0 and col = 0").select("row", "col", "score").distinct().collect()}
    assert fixed == {(2, 5, 2.5), (0, 0, -0.5)}


def test_scores_and_back(spark):
    rng = np.random.default_rng(8)
    v, w = np.round(rng.lognormal(0, 1, 400), 2), rng.uniform(0.1, 3, 400)
    frame = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, w, strict=True))], "id long, v double, weight double")
    scored = points.inverse_normal(points.normal_score(frame, weight="weight"), "p", "score").cache()
    order = np.argsort(v, kind="stable")
    share = w[order] / w.sum()
    want = [NormalDist().inv_cdf(p) for p in np.cumsum(share) - share / 2]
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert [got[k] for k in order.tolist()] == pytest.approx(want)
    ask = np.concatenate((rng.normal(0, 2, 500), [-9.0, 9.0], want))
    back = points.back_transform(spark.createDataFrame([(k, float(y)) for k, y in enumerate(ask)], "k long, y double"), "y", scored)
    assert [r["value"] for r in back.orderBy("k").collect()] == pytest.approx(np.interp(ask, want, v[order]).tolist(), abs=1e-6)


def test_simulated_values_stay_in_the_data_range(spark):
    d = "/root/testdata/sf0.001"
    b = geometry.points(spark, d).agg(F.min("v"), F.max("v")).first()
    rows = queries.gaussian_simulation(spark, d).collect()
    assert len(rows) == int(geometry.extent(spark, d) / 64) ** 2 and all(b[0] <= r["mean"] <= b[1] and r["n"] == 4 for r in rows)
    assert max(r["mean"] for r in rows) > 100


def test_trend_and_detrending(spark, sample):
    plane = sample.withColumn("v", 3 + 0.5 * F.col("x") - 0.25 * F.col("y"))
    left = kriging.detrended(plane, kriging.polynomial_trend(plane, 1))
    assert left.agg(F.max(F.abs("v"))).first()[0] < 1e-8


def test_decluster_weights_sum_to_n(sample):
    w = points.decluster_sweep(sample, [10.0, 30.0])
    assert [r[1] for r in w.groupBy("size").agg(F.sum("weight")).collect()] == pytest.approx([120.0, 120.0])


def test_slope_of_a_plane(spark):
    y, x = np.mgrid[0:6, 0:8]
    cells, ny, nx = cells_of(spark, 3.0 * x)
    inner = raster.slope_aspect(cells, ny, nx, 1.0).where("col between 1 and 6").collect()
    assert all(r["slope"] == pytest.approx(math.degrees(math.atan(3))) and r["aspect"] == pytest.approx(270) for r in inner)
    z = 3.0 * x
    z[2, 3] = np.nan
    cells, ny, nx = cells_of(spark, z)
    assert grid_of(raster.slope_aspect(cells, ny, nx, 1.0), "slope", z.shape)[1:4, 2:5].tolist() == [[pytest.approx(np.nan, nan_ok=True)] * 3] * 3


def test_cut_and_fill(spark):
    a, b = np.zeros((4, 4)), np.zeros((4, 4))
    b[0], b[1, :2], b[3, 3] = 2.0, -1.0, np.nan
    r = raster.cut_fill(cells_of(spark, a)[0], cells_of(spark, b)[0], 10.0, 0.5).first()
    assert (r["fill_volume"], r["cut_volume"], r["nodata"], r["flat_area"]) == (800.0, 200.0, 1, 900.0)


def test_contours_of_a_plane_are_straight(spark):
    y, x = np.mgrid[0:5, 0:6]
    lines = raster.contour_segments(*cells_of(spark, 1.0 * x), [2.5]).collect()
    assert len(lines) == 4 and all(r["x0"] == r["x1"] == 3.0 for r in lines)


def brute_d8(z):
    ny, nx = z.shape
    down = {}
    for i in range(ny):
        for j in range(nx):
            best, to = 0.0, None
            for di, dj in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)):
                a, b = i + di, j + dj
                if 0 <= a < ny and 0 <= b < nx:
                    s = (z[i, j] - z[a, b]) / math.hypot(di, dj)
                    if s > best:
                        best, to = s, a * nx + b
            down[i * nx + j] = to
    return down


def test_flow_accumulation_basins_and_orders(spark):
    z = np.random.default_rng(5).uniform(0, 10, (12, 15)) + np.arange(15)
    down = brute_d8(z)
    got = flow.receivers(*cells_of(spark, z)).cache()
    assert {r["cell"]: r["down"] for r in got.collect()} == down
    acc = dict.fromkeys(down, 0)
    ends = {}
    for c in down:
        p = c
        while p is not None:
            acc[p] += 1
            ends[c] = p
            p = down[p]
    assert {r["cell"]: r["acc"] for r in flow.accumulation(got).collect()} == acc
    assert {r["cell"]: r["outlet"] for r in flow.basins(got).collect()} == ends
    net = {c for c in acc if acc[c] >= 2}

    def order(c):
        ups = sorted((order(u) for u in net if down[u] == c), reverse=True)
        return 1 if not ups else ups[0] + (len(ups) > 1 and ups[0] == ups[1])

    streams = spark.createDataFrame([(c,) for c in net], "cell long")
    assert {r["cell"]: r["order"] for r in flow.strahler(got, streams).collect()} == {c: order(c) for c in net}


def test_fill_equals_the_priority_flood(spark):
    z = np.random.default_rng(7).uniform(0, 10, (9, 10))
    w, done, heap, eps = np.full(z.shape, np.inf), np.zeros(z.shape, bool), [], 0.001
    for i, j in np.ndindex(z.shape):
        if i in (0, 8) or j in (0, 9):
            w[i, j] = z[i, j]
            heapq.heappush(heap, (z[i, j], i, j))
    while heap:
        v, i, j = heapq.heappop(heap)
        if done[i, j]:
            continue
        done[i, j] = True
        for a in range(max(0, i - 1), min(9, i + 2)):
            for b in range(max(0, j - 1), min(10, j + 2)):
                n = max(z[a, b], v + eps)
                if n < w[a, b]:
                    w[a, b] = n
                    heapq.heappush(heap, (n, a, b))
    for tile in (256, 4):
        assert np.allclose(grid_of(flow.fill(*cells_of(spark, z), tile=tile), "z", z.shape), w)


def test_composite_is_length_weighted(spark):
    samples = spark.createDataFrame([("a", 0.0, 2.0, 1.0), ("a", 2.0, 5.0, None), ("a", 4.0, 6.0, 4.0), ("b", 0.0, 1.0, 9.0)], "hole_id string, frm double, to double, au double")
    targets = spark.createDataFrame([("a", 0.0, 6.0, "k"), ("c", 0.0, 5.0, "k")], "hole_id string, t_frm double, t_to double, code string")
    got = {r["hole_id"]: r for r in drill.composite(samples, targets, ["au"]).collect()}
    assert got["a"]["au"] == pytest.approx(2.5) and got["a"]["cover"] == pytest.approx(1.0) and got["a"]["overlap"] and got["a"]["au_cover"] == pytest.approx(4 / 6)
    assert got["c"]["cover"] == 0 and got["c"]["au"] is None


def test_axis_of_straight_and_curved_holes(spark):
    holes = spark.createDataFrame([("a", 0.0, 0.0, 100.0)], "hole_id string, x double, y double, z double")
    tilted = spark.createDataFrame([("a", 0.0, 90.0, 45.0), ("a", 10.0, 90.0, 45.0)], "hole_id string, md double, azi double, inc double")
    end = drill.axis(holes, tilted).orderBy(F.desc("md")).first()
    assert end["x"] == pytest.approx(10 / math.sqrt(2)) and end["z"] == pytest.approx(100 - 10 / math.sqrt(2))
    arc = spark.createDataFrame([("a", 0.0, 90.0, 0.0), ("a", math.pi / 2 * 50, 90.0, 90.0)], "hole_id string, md double, azi double, inc double")
    end = drill.axis(holes, arc).orderBy(F.desc("md")).first()
    assert (end["x"], end["z"]) == (pytest.approx(50), pytest.approx(50))


def test_rectangular_channel(spark):
    p = spark.createDataFrame([(1, k, d, z) for k, (d, z) in enumerate([(0.0, 5.0), (0.0, 0.0), (10.0, 0.0), (10.0, 5.0)])], "sec int, seq int, d double, z double")
    r = section.rating(p, spark.createDataFrame([(1, 2.0)], "sec int, level double"), 0.03, 0.001).first()
    assert (r["area"], r["width"], r["perimeter"]) == (20.0, 10.0, 14.0)
    assert r["q"] == pytest.approx(20 / 0.03 * (20 / 14) ** (2 / 3) * math.sqrt(0.001))


def test_stations_and_projection(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0)], "line int, seq int, x double, y double")
    got = [(r["d"], r["x"], r["y"]) for r in section.stations(line, 4.0).orderBy("d").collect()]
    assert got == [(0, 0, 0), (4, 4, 0), (8, 8, 0), (12, 10, 2), (16, 10, 6)]
    p = spark.createDataFrame([(7, 1, 12.0, 5.0)], "id int, line int, x double, y double")
    assert tuple(section.project(p, line).first())[2:] == (15.0, 2.0)


def test_density_keeps_mass_in_batches_and_streams(spark, tmp_path):
    grid = density.Grid(0.0, 0.0, 10.0, 20, 20)
    src = spark.createDataFrame([(i, float(i * 7 % 200), float(i * 13 % 200), 5.0, 12.0) for i in range(30)], "id long, x double, y double, mass double, sigma double")
    whole = density.points(src, grid)
    assert whole.agg(F.sum("mass")).first()[0] == pytest.approx(150.0)
    ring = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y) in enumerate([(20.0, 20.0), (80.0, 20.0), (80.0, 60.0), (20.0, 60.0)])], "polygon int, ring int, seq int, x double, y double")
    assert density.inside(ring, grid).count() == 24
    src.where("id < 15").write.parquet(f"{tmp_path}/in")
    run = lambda: stream.accumulate(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), grid, f"{tmp_path}/out", f"{tmp_path}/ck", True).awaitTermination()
    run()
    src.where("id >= 15").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    want = {(r["row"], r["col"]): r["density"] for r in density.finalise(whole, grid).collect()}
    got = {(r["row"], r["col"]): r["density"] for r in stream.density_map(spark, f"{tmp_path}/out", grid).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_dimensions_of_known_shapes(spark):
    mask = np.ones((1, 1), bool)
    for _ in range(5):
        mask = np.block([[mask, np.zeros_like(mask)], [mask, mask]])
    cells = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask), strict=True)], "row int, col int")
    assert fractal.box_dimension(fractal.box_counts(cells, 32, 32)).first()["dimension"] == pytest.approx(math.log2(3), abs=0.01)
    line = spark.createDataFrame([(1, k, float(k), 2.0 * k) for k in range(200)], "line int, seq int, x double, y double")
    assert fractal.divider(line).first()["dimension"] == pytest.approx(1.0, abs=0.05)
    y, x = np.mgrid[0:10, 0:10]
    inner = fractal.detrended_variance(*cells_of(spark, 2.0 * x + 3.0 * y), 2).where("row between 2 and 7 and col between 2 and 7")
    assert raster_max(inner) < 1e-9


def raster_max(df):
    return df.agg(F.max("variance")).first()[0]


def test_scalar_functions(spark):
    one = spark.range(1)
    p = one.select(scalar.normal_cdf(F.lit(1.96)).alias("a"), scalar.exceedance(F.lit(5.0), F.lit(0.0), 4.0).alias("b"), scalar.number(F.lit(" 1 234,5")).alias("c"), scalar.number(F.lit("nan")).alias("d"), scalar.manning(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("e")).first()
    assert p["a"] == pytest.approx(0.9750021, abs=1e-6) and (p["b"], p["c"], p["d"], p["e"]) == (1.0, 1234.5, None, 0.0)


def test_sources(spark, tmp_path):
    text = '{"elements": [{"type": "way", "id": 1, "tags": {"highway": "track", "name": "R"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}, {"type": "node", "id": 2, "lat": 3.0, "lon": 4.0, "tags": {"natural": "peak", "ele": "123,5 m"}}]}'
    got = {r["id"]: r for r in tables.osm_elements(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got[1]["kind"] == "road" and len(got[1]["points"]) == 2 and got[2]["ele"] == 123.5
    beds = spark.createDataFrame([("A", "2", "bed", "FF0000", "s", None), ("А", "1", "bed", "x", "s", None), ("B", "1", "bed", None, "s", None)], "code string, order string, body string, color string, strata string, note string")
    assert [(r["code"], r["color"]) for r in tables.bed_reference(beds).collect()] == [("B", None), ("A", "#ff0000")]
    r = spark.range(1).select(tables.tile_name(F.lit(-3.2), F.lit(57.9)).alias("t"), *tables.slippy_tile(F.lit(0.0), F.lit(0.0), 3), tables.utm_zone(F.lit(60.0), F.lit(57.0)).alias("u")).first()
    assert tuple(r) == ("S04E057", 4, 4, 32640)
    (tmp_path / "c.csv").write_text("BHID,From,To,Lith\n a ,\"1,5\",2,X\n")
    assert tuple(tables.read_table(spark, str(tmp_path / "c.csv"), {"hole_id": "text", "frm": "number", "to": "number", "code": "text"}).first()) == ("a", 1.5, 2.0, "X")
    (tmp_path / "l.xml").write_text('<?xml version="1.0"?><LandXML><CgPoints><CgPoint name="p1">10.0 20.0 3.5</CgPoint><CgPoint name="p2">1 2</CgPoint></CgPoints></LandXML>')
    assert {r["name"]: (r["x"], r["y"], r["z"]) for r in tables.land_points(spark, str(tmp_path / "l.xml")).collect()} == {"p1": (20.0, 10.0, 3.5), "p2": (2.0, 1.0, None)}
    z = np.arange(12.0).reshape(3, 4)
    tables.write_raster(cells_of(spark, z)[0], str(tmp_path / "r"), 2)
    assert tables.read_raster(spark, str(tmp_path / "r"), (2, 2), 2).count() == 4
