"""Polylines, surfaces, flow lines and kriging options against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import ranks, scalar
from orogen.operators import density, drill, flow, fractal, kriging, lines, raster, section, splines, subsidence, variogram
from orogen.sources import tables
from tests.core.test_operators import brute_d8, cells_of, grid_of

LINE = "line int, seq int, x double, y double"


def bowl(n):
    y, x = np.mgrid[0:n, 0:n]
    return np.hypot(x - (n - 1) / 2, y - (n - 1) / 2)


def test_contours_chain_into_rings_and_lines(spark):
    z = bowl(21)
    got = lines.contour_polylines(raster.contour_segments(*cells_of(spark, z), [4.3, 13.0])).collect()
    ring = sorted((r["seq"], r["x"], r["y"]) for r in got if r["level"] == 4.3)
    assert all(r["closed"] for r in got if r["level"] == 4.3) and len({r["line"] for r in got if r["level"] == 4.3}) == 1
    assert ring[0][1:] == ring[-1][1:] and [k for k, _, _ in ring] == list(range(len(ring)))
    p = np.array([q[1:] for q in ring])
    assert np.hypot(*np.diff(p, axis=0).T).max() < 1.5 and np.hypot(*np.diff(p, axis=0).T).sum() == pytest.approx(2 * math.pi * 4.3, rel=0.02)
    assert len({r["line"] for r in got if r["level"] == 13.0}) == 4 and not any(r["closed"] for r in got if r["level"] == 13.0)
    rng = np.random.default_rng(2)
    pieces = raster.contour_segments(*cells_of(spark, rng.uniform(0, 1, (12, 14))), [0.5]).cache()
    ends = {}
    for r in pieces.collect():
        for n in (r["n0"], r["n1"]):
            ends[n] = ends.get(n, 0) + 1
    found = lines.contour_polylines(pieces).groupBy("line", "closed").agg(F.count("*").alias("n")).collect()
    assert sum(not r["closed"] for r in found) * 2 == sum(k == 1 for k in ends.values()) and sum(r["n"] - 1 for r in found) == pieces.count()


def test_levels(spark):
    assert lines.contour_levels(10.0, 50.0, 10.0) == [20.0, 30.0, 40.0] and lines.contour_levels(5.0, 5.0, 1.0) == []
    got = lines.thinned_levels(spark.createDataFrame([(float(k),) for k in range(9)], "level double"), 4).where("check").collect()
    assert [r["level"] for r in got] == [4.0]
    a, b = spark.range(1).select(*[c.alias(n) for c, n in zip(lines.corridor(F.lit(10.0), F.lit(8.0), F.lit(None).cast("double"), 4.0), "ab", strict=True)]).first()
    assert (a, b) == (9.0, 12.0)
    assert scalar.nice_interval(0, 97) == 10.0 and scalar.nice_interval(1, 1) == 0.0 and scalar.nice_ticks(0, 10, 6) == [0, 2, 4, 6, 8, 10]


def test_areas_and_volumes_above_levels(spark):
    z = bowl(41)
    above = {r["level"]: r for r in raster.above_levels(*cells_of(spark, -z), [-12.0, -6.0], 1.0).collect()}
    assert above[-12.0]["area"] == pytest.approx(math.pi * 144, rel=0.01) and above[-6.0]["area"] == pytest.approx(math.pi * 36, rel=0.02)
    assert above[-12.0]["volume"] == pytest.approx(math.pi * 12**3 / 3, rel=0.01)  # a cone
    band = raster.level_bands(raster.above_levels(*cells_of(spark, -z), [-12.0, -6.0], 1.0)).first()
    assert band["area"] == pytest.approx(above[-12.0]["area"] - above[-6.0]["area"])


def test_thinning_and_rounding(spark):
    path = [(1, k, float(k), 0.01 * (k % 2)) for k in range(10)] + [(2, k, *p) for k, p in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    frame = spark.createDataFrame(path, LINE)
    assert {r["line"]: r["n"] for r in lines.simplified(frame, 0.1).groupBy("line").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 5}
    ring = [(r["x"], r["y"]) for r in lines.rounded_corners(frame.where("line = 2")).orderBy("seq").collect()]
    assert len(ring) == 9 and ring[0] == ring[-1] == (0.0, 1.0) and ring[1] == (1.0, 0.0)
    bent = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 4.0)], LINE)
    assert [(r["x"], r["y"]) for r in lines.rounded_corners(bent).orderBy("seq").collect()] == [(0.0, 0.0), (3.0, 0.0), (4.0, 1.0), (4.0, 4.0)]


def test_crossings_with_heights(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], LINE)
    b = spark.createDataFrame([(7, 0, 2.0, -1.0, 0.0), (7, 1, 2.0, 3.0, 8.0), (7, 2, 9.0, -1.0, 8.0)], "line int, seq int, x double, y double, z double")
    got = sorted((round(r["d"], 9), round(r["z"], 9)) for r in lines.crossings(a, b, 3.0).collect())
    assert got == [(2.0, 2.0), (7.25, 8.0)]


def test_mesh_sections_keep_overhangs(spark):
    tri = [("a", 0.0, -1.0, 0.0, 10.0, -1.0, 10.0, 5.0, 9.0, 5.0), ("b", 2.0, -1.0, 20.0, 4.0, -1.0, 20.0, 3.0, 1.0, 20.0), ("far", 50.0, 50.0, 0.0, 51.0, 50.0, 0.0, 50.0, 51.0, 0.0)]
    mesh = spark.createDataFrame(tri, "triangle string, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], LINE)
    got = {r["triangle"]: r for r in lines.mesh_section(line, mesh, 4.0).collect()}
    assert set(got) == {"a", "b"} and (got["b"]["d0"], got["b"]["z0"], got["b"]["d1"]) == (pytest.approx(2.5), 20.0, pytest.approx(3.5))
    assert got["a"]["z0"] == pytest.approx(got["a"]["d0"]) and got["a"]["d0"] == pytest.approx(0.5) and got["a"]["d1"] == pytest.approx(9.5)


def test_stations_and_back(spark):
    bent = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0)], LINE)
    ask = spark.createDataFrame([(k, 1, *v) for k, v in enumerate([(5.0, 2.0), (15.0, -1.0), (-3.0, 0.0), (25.0, 1.0)])], "id int, line int, sta double, offset double")
    got = {r["id"]: (round(r["x"], 9), round(r["y"], 9)) for r in lines.at_stations(bent, ask).collect()}
    assert got == {0: (5.0, -2.0), 1: (9.0, 5.0), 2: (-3.0, 0.0), 3: (11.0, 15.0)}
    back = {r["id"]: (r["sta"], r["offset"]) for r in lines.station_offsets(lines.at_stations(bent, ask.where("id < 2")), bent).collect()}
    assert back == {0: (5.0, 2.0), 1: (15.0, -1.0)}
    assert lines.unwrapped(spark.createDataFrame([(2.0, 0.0)], "x double, y double"), 0.0, 0.0, 2.0).first()["d"] == pytest.approx(math.pi)


def test_attitudes_of_a_dipping_plane(spark):
    rows = [(1, k, x, y, 100 - 0.5 * x) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 2.0), (3.0, 1.0), (4.0, 5.0), (6.0, 2.0), (7.0, 7.0)])] + [(2, k, float(k), 0.0, float(k)) for k in range(6)]
    got = lines.trace_attitudes(spark.createDataFrame(rows, "line int, seq int, x double, y double, z double"), 5).collect()
    assert {r["line"] for r in got} == {1} and [r["seq"] for r in got] == [2, 3]
    assert all(r["dip"] == pytest.approx(math.degrees(math.atan(0.5))) and r["azimuth"] == pytest.approx(90) and r["rms"] < 1e-9 for r in got)


def test_runs_along_lines(spark):
    flags = [0, 1, 0, 0, 1, 1, 1, 0, 0]
    t = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate(flags)], "line int, seq int, doubtful boolean")
    got = sorted((r["first"], r["last"], r["doubtful"]) for r in lines.confident_runs(t).collect())
    assert got == [(0, 3, False), (3, 7, True), (7, 8, False)]
    rng = np.random.default_rng(4)
    for seed in range(3):
        s, z = np.cumsum(rng.uniform(5, 15, 40)), np.cumsum(rng.normal(-4, 6, 40))
        ways = spark.createDataFrame([(seed, k, float(a), float(b)) for k, (a, b) in enumerate(zip(s, z, strict=True))], "start int, step int, s double, z double")
        best = max(((s[j] - s[i]) for i in range(40) for j in range(i, 40) if z[i] - z[j] >= 0.4 * (s[j] - s[i])), default=0.0)
        assert lines.steep_runs(ways, 0.4).first()["length"] == pytest.approx(best)
        cut = 40
        for j in range(1, 40):
            back = [i for i in range(j) if s[j] - s[i] >= 60]
            if back and (z[back[-1]] - z[j]) / (s[j] - s[back[-1]]) < 0.4:
                cut = back[-1] + 1
                break
        assert lines.cut_on_flattening(ways, 0.4, 60.0).count() == cut


def test_bridges_go_down_to_the_water(spark):
    z = np.full((9, 12), 50.0)
    z[4] = 10 - 0.1 * np.arange(12)  # a river
    banks = z.copy()
    z[:, 5:7] = 60.0  # a bridge over it
    mask = spark.createDataFrame([(i, j) for i in range(9) for j in (5, 6)], "row int, col int")
    got = grid_of(raster.bridges_removed(cells_of(spark, z)[0], mask, 9, 12), "z", z.shape)
    assert got[4].tolist() == pytest.approx(banks[4].tolist()) and (got <= z).all() and got[0].tolist() == pytest.approx([50.0] * 12)


def test_shift_between_surfaces(spark):
    y, x = np.mgrid[0:10, 0:12]
    a, b = 3.0 + 0.5 * x - 0.25 * y, np.zeros((10, 12))
    assert raster.height_shift(cells_of(spark, a)[0], cells_of(spark, a - 7)[0])["c"] == pytest.approx(7.0)
    got = raster.height_shift(cells_of(spark, a)[0], cells_of(spark, b)[0], plane=True)
    assert (got["x"], got["y"], got["c"]) == (pytest.approx(0.5), pytest.approx(-0.25), pytest.approx(3.0))


def test_splines_carry_planes_and_meet_points(spark):
    rng = np.random.default_rng(5)
    p = [(k, float(x), float(y), float(2.0 * x - y + 5)) for k, (x, y) in enumerate(rng.uniform(0, 50, (60, 2)))]
    frame = spark.createDataFrame(p, "id long, x double, y double, v double")
    flat = splines.fit(frame, levels=1)
    assert flat.worst < 1e-9
    rough = frame.withColumn("v", F.sin(F.col("x") / 9) * 10)
    few, many = splines.fit(rough, levels=1), splines.fit(rough, levels=5, tolerance=1e-6)
    assert many.worst < 0.1 * few.worst
    got = splines.evaluate(many, rough).join(rough, "id").agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0]
    assert got == pytest.approx(many.worst, abs=1e-6)


def test_faults_hide_samples(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 2.0), (2, 0.0, 10.0, 3.0), (3, 10.0, 10.0, 4.0), (4, -5.0, 0.0, 5.0)], "id long, x double, y double, v double")
    wall = spark.createDataFrame([(5.0, -20.0, 5.0, 20.0), (100.0, 100.0, 101.0, 101.0)], "x0 double, y0 double, x1 double, y1 double")
    target = spark.createDataFrame([(9, 0.0, 5.0), (8, 5.0, 5.0)], "id long, x double, y double")
    seen = {r["id"]: {(n["x"], n["y"]) for n in r["near"]} for r in kriging.neighbours(target, p, 30.0, 9, faults=wall).collect()}
    assert seen[9] == {(0.0, 0.0), (0.0, 10.0), (-5.0, 0.0)} and len(seen[8]) == 5  # on the wall, all are seen


def test_local_fabric_turns_the_model(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(x), float(y), float(np.sin(y / 3)), 90.0) for k, (x, y) in enumerate(rng.uniform(0, 60, (300, 2)))]
    p = spark.createDataFrame(rows, "id long, x double, y double, v double, a double")
    model = kriging.Model("spherical", 1.0, 40.0, anisotropy=0.15)  # long axis north
    targets = spark.createDataFrame([(k, 10.0 + k * 4, 30.0 + k) for k in range(10)], "id long, x double, y double")
    error = lambda s: sum((r["estimate"] - math.sin((30.0 + r["id"]) / 3)) ** 2 for r in kriging.krige(targets, s, model, 30.0).collect())
    assert error(p) < 0.2 * error(p.drop("a"))
    turned = kriging.Model("spherical", 1.0, 40.0, azimuth=90.0, anisotropy=0.15)
    a, b = (sorted((r["id"], r["estimate"]) for r in kriging.krige(targets, s, m, 30.0).collect()) for s, m in ((p, model), (p.drop("a"), turned)))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])


def test_drift_and_detrended_validation(spark):
    rng = np.random.default_rng(7)
    p = [(k, float(x), float(y), float(3 + 2 * np.sin(x)), float(np.sin(x))) for k, (x, y) in enumerate(rng.uniform(0, 30, (60, 2)))]
    frame = spark.createDataFrame(p, "id long, x double, y double, v double, s double")
    ask = spark.createDataFrame([(1, 11.0, 12.0, 0.25)], "id long, x double, y double, s double")
    model = kriging.Model("spherical", 1.0, 10.0)
    assert kriging.krige_with_drift(ask, frame, model, 20.0).first()["estimate"] == pytest.approx(3.5)
    noisy = frame.withColumn("v", F.col("x") * 0.7 - F.col("y") + F.sin(F.col("id") * 1.7))
    got = {r["id"]: r["estimate"] for r in kriging.cross_validate_detrended(noisy, model, 1, 12.0).collect()}
    for i in (3, 20, 41):
        rest = noisy.where(F.col("id") != i)
        trend = kriging.polynomial_trend(rest, 1)
        here = noisy.where(F.col("id") == i).select("id", "x", "y")
        at = here.first()
        level = trend["b0"] + trend["b1"] * (at["x"] - trend["mx"]) / trend["sx"] + trend["b2"] * (at["y"] - trend["my"]) / trend["sy"]
        want = kriging.krige(here, kriging.detrended(rest, trend), model, 12.0).first()["estimate"]
        assert (want is None and got[i] is None) or got[i] == pytest.approx(level + want)


def test_anisotropy_is_found(spark):
    rng = np.random.default_rng(8)
    pts = rng.uniform(0, 100, (700, 2))
    v = np.sin(pts[:, 0] / 6)  # changes fast eastwards, not at all northwards
    frame = spark.createDataFrame([(k, float(x), float(y), float(z)) for k, ((x, y), z) in enumerate(zip(pts, v, strict=True))], "id long, x double, y double, v double")
    got = variogram.anisotropy(frame, 15, 40.0)
    assert got["resolved"] and min(got["azimuth"], 180 - got["azimuth"]) <= 15 and got["ratio"] < 0.6 and got["capped"]


def test_fit_follows_its_rules():
    lag = np.linspace(5, 100, 12)
    flat = variogram.fit(lag, np.full(12, 2.0), np.full(12, 10.0))
    assert flat["nugget"] + flat["sill"] == pytest.approx(2.0, rel=0.05) and 5.0 <= flat["range"] <= 150.0
    steep = variogram.fit(lag, lag * 0.1, np.full(12, 10.0))
    assert steep["nugget"] + steep["sill"] <= 1.15 * 10 + 1e-9 and steep["range"] <= 150.0
    assert variogram.fit(lag[:2], lag[:2], lag[:2]) is None


def test_links_orders_gauges_and_traces(spark):
    z = np.random.default_rng(9).uniform(0, 10, (14, 16)) + np.arange(16)
    cells, ny, nx = cells_of(spark, z)
    down = flow.receivers(cells, ny, nx).cache()
    acc = flow.accumulation(down).cache()
    to, size = brute_d8(z), {r["cell"]: r["acc"] for r in acc.collect()}
    net = {c for c in size if size[c] >= 3}
    ups = lambda c: [u for u in net if to[u] == c]
    want = {}
    for head in [c for c in net if len(ups(c)) != 1]:
        path = [head]
        while to[path[-1]] in net:
            path.append(to[path[-1]])
            if len(ups(path[-1])) != 1:
                break
        if len(path) >= 2:
            want[head] = (path[-1], len(path))
    got = {r["link"]: (r["end"], r["n_cells"]) for r in flow.river_network(down, acc, 3).collect()}
    assert got == want
    stop = spark.createDataFrame([(c,) for c in list(size)[::9]], "cell long")
    held = {r["cell"] for r in stop.collect()}
    starts = spark.createDataFrame([(c,) for c in (5, 40, 77, 150)], "cell long")
    paths = {}
    for c in (5, 40, 77, 150):
        path = [c]
        while path[-1] not in held and to[path[-1]] is not None:
            path.append(to[path[-1]])
        paths[c] = path
    ways = flow.trace(down, starts, stop)
    found = {}
    for r in ways.orderBy("start", "step").collect():
        found.setdefault(r["start"], []).append(r["cell"])
    assert found == paths
    ends = {r["start"]: r["reason"] for r in flow.trace_metrics(ways, cells, down, ny, nx, 10.0, stop).collect()}
    assert all((ends[c] == "receiver") == (p[-1] in held) for c, p in paths.items())
    merged = flow.trace(down, down.select("cell"), merge=True).groupBy("cell").agg(F.count("*").alias("n"))
    assert merged.count() == len(size)
    seed = max(size, key=size.get)
    mine = {r["cell"] for r in flow.catchments(down, spark.createDataFrame([(seed,)], "cell long")).collect()}
    assert len(mine) == size[seed]


def test_known_findings_of_stacks(spark):
    rows = [(0, k, 0, 90.0, 100.0) for k in range(10)] + [(1, 0, 0, 100.0, 89.0), (1, 0, 1, 92.0, 80.0), (2, 0, 0, 100.0, None), (2, 0, 1, 90.0, 89.99)]
    beds = spark.createDataFrame(rows, "row int, col int, rank int, top double, bottom double")
    known = spark.createDataFrame([(0, k) for k in range(5)], "row int, col int")
    got = {(r["row"], r["col"]): r["code"] for r in section.stack_codes(beds, 0.05, known).collect()}
    assert [got[0, k] for k in range(10)] == [4] * 5 + [2] * 5 and got[1, 0] == 3 and got[2, 0] == 1
    report = {r["rank"]: r for r in section.stack_report(beds, 0.05, known).collect()}
    assert (report[0]["n_known"], report[0]["n_neg"], report[0]["n_cross"], report[1]["n_zero"]) == (5, 5, 1, 1)


def test_deformations_are_reduced(spark):
    rows = [(1, 0.0, 0.0), (1, 45.0, 0.09), (1, 90.0, 0.27)]
    got = section.deformations(spark.createDataFrame(rows, "profile int, d double, settle double")).orderBy("d").collect()
    q = 1 + 0.1414 * math.sqrt(2)
    assert got[0]["tilt"] == pytest.approx(0.002 * q) and got[1]["curvature"] == pytest.approx(0.002 * q / 45 * (1 + 0.1768 * math.sqrt(2)))
    one = spark.range(1).select(scalar.trough_shape(F.lit(0.0)).alias("a"), scalar.trough_shape(F.lit(0.5)).alias("b"), scalar.trough_shape(F.lit(2.0)).alias("c"), scalar.strain(F.lit(2e-4), F.lit(100.0)).alias("d"), scalar.inverse_normal(F.lit(0.975)).alias("e")).first()
    assert (one["a"], one["b"], one["c"]) == (1.0, pytest.approx(0.29), pytest.approx(0.0)) and one["d"] == pytest.approx(0.001) and one["e"] == pytest.approx(1.959963985)


def test_clamped_smoothing_keeps_planes_and_tiles(spark):
    y, x = np.mgrid[0:20, 0:30]
    plane = 2.0 * x - 0.5 * y
    assert np.allclose(grid_of(raster.smooth_clamped(*cells_of(spark, plane), 10.0, 20), "z", plane.shape), plane)
    z = np.random.default_rng(3).uniform(0, 10, (20, 30))
    z[4, 5] = np.nan
    whole, tiled = (grid_of(raster.smooth_clamped(*cells_of(spark, z), 4.0, 20, tile=t), "z", z.shape) for t in (256, 7))
    assert np.allclose(whole, tiled, equal_nan=True) and np.nanmax(np.abs(whole - z)) <= 2.0 + 1e-9 and np.isnan(whole[4, 5])


def test_survey_references(spark):
    ref = lambda v: drill.vertical_reference(spark.createDataFrame([(x,) for x in v], "inc double")).first()[0]
    assert (ref([0.0, 1.0, -60.0]), ref([-89.0, -90.0, 0.0]), ref([90.0]), ref([-50.0]), ref([]), ref([40.0])) == (0.0, -90.0, 90.0, -90.0, 0.0, 0.0)
    rows = [("a", 10.0, 5.0, -90.0), ("a", 20.0, 5.0, -60.0), ("a", 20.0, 7.0, -10.0), ("b", 0.0, 0.0, -88.0)]
    got = sorted(tuple(r) for r in drill.surveyed(spark.createDataFrame(rows, "hole_id string, md double, azi double, inc double")).collect())
    assert got == [("a", 10.0, 5.0, 0.0), ("a", 20.0, 5.0, 30.0), ("b", 0.0, 0.0, 2.0)]


def test_land_xml_goes_out_and_back(spark, tmp_path):
    tri = spark.createDataFrame([("s", 0, 0.0, 0.0, 1.0, 10.0, 0.0, 2.0, 0.0, 10.0, 3.0), ("s", 1, 10.0, 0.0, 2.0, 10.0, 10.0, 4.0, 0.0, 10.0, 3.0)], "surface string, triangle int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    tables.write_land_xml(tri, str(tmp_path / "out"))
    got = tables.land_surfaces(spark, str(tmp_path / "out" / "surface=s"))
    assert sorted(map(tuple, got.select(tri.columns).collect())) == sorted(map(tuple, tri.collect()))
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><LandXML><Units><Imperial linearUnit="foot"/></Units><Alignments><Alignment name="ax" staStart="100"><CoordGeom><Line><Start>0 0</Start><End>0 10</End></Line><Line><Start>0 10</Start><End>10 10</End></Line></CoordGeom></Alignment></Alignments></LandXML>')
    axis = tables.land_alignments(spark, str(tmp_path / "a.xml")).orderBy("seq").collect()
    assert [(r["seq"], round(r["x"], 4), round(r["y"], 4)) for r in axis] == [(0, 0.0, 0.0), (1, 3.048, 0.0), (2, 3.048, 3.048)] and axis[0]["start"] == pytest.approx(30.48)
    (tmp_path / "bad.xml").write_text('<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><LandXML/>')
    with pytest.raises(ValueError):
        tables.land_surfaces(spark, str(tmp_path / "bad.xml"))


def test_tables_merge(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2.5, 7)], "id double, other int")
    got = tables.merged([a, b], ("name",))
    assert got.columns == ["id", "name_1", "other"] and dict(got.dtypes)["id"] == "string" and got.count() == 2
    old, new = spark.createDataFrame([("l", "top", 1), ("k", "x", 2)], "layer string, role string, n int"), spark.createDataFrame([("l", None, 5)], "layer string, role string, n int")
    assert sorted(map(tuple, tables.manifest_merged(old, new).collect())) == [("k", "x", 2), ("l", "top", 5)]
    rows = spark.createDataFrame([("b", "2", 0), ("c", None, 1), ("a", "10", 2), ("d", "x", 3)], "name string, k string, seq int")
    assert [r["name"] for r in tables.section_order(rows, "k", "seq").collect()] == ["b", "a", "c", "d"]


def test_boxes_and_dimensions_follow_their_rules(spark):
    mask = spark.createDataFrame([(i, j) for i in range(32) for j in range(32)], "row int, col int")
    assert {r["size"]: r["n"] for r in fractal.box_counts(mask, 32, 32).collect()} == {2: 256, 4: 64}
    y, x = np.mgrid[0:20, 0:20]
    got = fractal.dimension_map(cells_of(spark, 1.0 * x + y)[0], 5).collect()
    assert len(got) == 400 and all(r["dimension"] == pytest.approx(2.0) and r["hurst"] == pytest.approx(1.0) for r in got)


def test_grid_deformations_of_a_bowl(spark):
    y, x = np.mgrid[0:30, 0:30]
    z = 1e-4 * ((x * 10.0) ** 2 + 3 * (y * 10.0) ** 2)  # settlement grows east and south
    got = {(r["row"], r["col"]): r for r in subsidence.deformations(*cells_of(spark, z), 10.0, 15.0, False).collect()}
    r = got[12, 14]
    gx, gy = 2e-4 * 140, -6e-4 * 120
    # Between centres the surface is a chord; on a parabola half a cell off adds the same to both sides, and a quarter square to curvature.
    assert r["tilt"] == pytest.approx(math.hypot(gx, gy)) and r["azimuth"] == pytest.approx(math.degrees(math.atan2(gx, gy)) % 360)
    assert r["k_max"] / r["k_min"] == pytest.approx(3.0) and r["k_max_az"] == pytest.approx(0.0, abs=1e-6)
    assert got[0, 0]["tilt"] is None and got[0, 0]["k_max"] is None
    bowl = grid_of(subsidence.trough(spark, 20, 20, 50.0, 100.0, 600.0, 600.0, 2.0), "z", (20, 20))
    assert bowl.max() == pytest.approx(2.0) and bowl[10, 10] == pytest.approx(2.0) and bowl[0, 0] < 0.1 and np.allclose(bowl, bowl[::-1, ::-1])


def test_grafts_pass_smoothly(spark):
    y, x = np.mgrid[0:20, 0:24]
    coarse, fine = 0.5 * x, np.where((x > 3) & (x < 20), 0.5 * x + 4 + np.sin(y), np.nan)
    mask = spark.createDataFrame([(i, j) for i in range(6, 14) for j in range(8, 16)], "row int, col int")
    away = {(r["row"], r["col"]): r["distance"] for r in raster.distance_to(mask, cells_of(spark, coarse)[0], 3.0).collect()}
    want = {(i, j): min(math.hypot(i - a, j - b) for a in range(6, 14) for b in range(8, 16)) for i in range(20) for j in range(24)}
    assert away == {k: pytest.approx(v) for k, v in want.items() if v <= 3.0}
    got = grid_of(raster.grafted(cells_of(spark, fine)[0], cells_of(spark, coarse)[0], mask, 3.0), "z", coarse.shape)
    assert np.allclose(got[6:14, 8:16], fine[6:14, 8:16]) and np.isfinite(got).all()
    shift = got[0, 0] - coarse[0, 0]
    assert got[19, 23] - coarse[19, 23] == pytest.approx(shift) and abs(shift - 4) < 1


def test_polygons_keep_their_mass(spark):
    grid = density.Grid(0.0, 0.0, 10.0, 20, 20)
    ring = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y) in enumerate([(20.0, 20.0), (80.0, 20.0), (80.0, 60.0), (20.0, 60.0)])], "polygon int, ring int, seq int, x double, y double")
    mass = spark.createDataFrame([(1, 48.0)], "polygon int, mass double")
    even = density.polygons(ring, mass, grid).collect()
    assert len(even) == 24 and all(r["mass"] == pytest.approx(2.0) for r in even) and even[0]["sigma_mass"] == pytest.approx(2 * math.sqrt(2400 / math.pi))
    w = spark.createDataFrame([(3, 3, 1.0), (4, 4, 3.0), (5, 5, -2.0)], "row int, col int, w double")
    dasymetric = {(r["row"], r["col"]): r["mass"] for r in density.polygons(ring, mass, grid, w).collect() if r["mass"] > 0}
    assert dasymetric == {(3, 3): 12.0, (4, 4): 36.0}


def test_quantiles_are_exact_by_narrowing(spark):
    rng = np.random.default_rng(10)
    for values in (rng.normal(0, 1, 3000), np.repeat([1.0, 2.0, 3.0], 1000), np.concatenate((np.zeros(2500), rng.uniform(0, 1, 500)))):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.02, 0.5, 0.9, 1.0]
        assert ranks.quantiles(frame, "v", shares, most=50) == pytest.approx(np.quantile(values, shares).tolist())
    assert ranks.quantiles(frame.limit(0), "v", [0.5]) == [None]
