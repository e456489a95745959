"""Profiles of slope lines and pairs of crests and toes against brute force."""

import numpy as np
import pytest

from orogen.operators import slopes

LINE = "line int, seq int, x double, y double"


def test_heights_between_contours(spark):
    lines = spark.createDataFrame([(1, k, float(10 * k), 0.0) for k in range(11)] + [(2, k, x, y) for k, (x, y) in enumerate(((0.0, 50.0), (40.0, 50.0), (40.0, 90.0), (0.0, 90.0), (0.0, 50.0)))] + [(3, 0, 500.0, 500.0), (3, 1, 510.0, 500.0)], LINE)
    contours = spark.createDataFrame([(1, 0, 25.0, -9.0, 100.0), (1, 1, 25.0, 9.0, 100.0), (2, 0, 65.0, 0.4, 90.0), (2, 1, 65.0, 30.0, 90.0), (3, 0, 10.0, 45.0, 10.0), (3, 1, 10.0, 55.0, 10.0), (4, 0, 35.0, 70.0, 20.0), (4, 1, 45.0, 70.0, 20.0), (5, 0, 1.0, 1.0, None), (5, 1, 2.0, 2.0, None)], LINE + ", z double")
    spots = spark.createDataFrame([(1, 95.0, 0.3, 88.0), (2, 95.0, 300.0, 1.0)], "id int, x double, y double, z double")
    found = slopes.samples(lines, contours, 0.5, spots)
    assert sorted((r["line"], round(r["d"], 6), r["z"]) for r in found.collect()) == [(1, 25.0, 100.0), (1, 65.0, 90.0), (1, 95.0, 88.0), (2, 10.0, 10.0), (2, 60.0, 20.0)]
    got = {(r["line"], r["seq"]): (r["z"], r["n_samples"]) for r in slopes.profiled(lines, found).collect()}
    want = np.interp(np.arange(11) * 10, [25, 65, 95], [100, 90, 88])
    assert [got[1, k][0] for k in range(11)] == pytest.approx(want.tolist()) and got[1, 0][1] == 3
    ring = np.interp([0, 40, 80, 120, 160], [-100, 10, 60, 170, 220], [20, 10, 20, 10, 20])
    assert [got[2, k][0] for k in range(5)] == pytest.approx(ring.tolist())
    assert got[3, 0] == (None, 0)


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n, z: [(i, k, float(x), float(y), float(h)) for i in range(n) for h in [rng.uniform(*z)] for k, (x, y) in enumerate(rng.uniform(0, 300, 2) + rng.uniform(-20, 20, (4, 2)))]
    crests, toes = make(25, (5, 30)), make(20, (10, 25))
    got = slopes.paired(spark.createDataFrame(crests, LINE + ", z double"), spark.createDataFrame(toes, LINE + ", z double"), 40.0).collect()
    used = set()
    for r in (r for r in got if r["kind"] == "brow"):
        own = np.array([c[2:4] for c in crests if c[0] == r["line"]])
        z = next(c[4] for c in crests if c[0] == r["line"])
        options = [(np.hypot(*(own[:, None] - np.array([t[2:4] for t in toes if t[0] == j])).T).min(), j) for j in range(20) if next(t[4] for t in toes if t[0] == j) < z]
        best = min(options, default=(np.inf, None))
        if best[0] <= 40:
            assert (r["toe"], r["reason"]) == (best[1], None) and r["distance"] == pytest.approx(best[0])
            used.add(best[1])
        else:
            assert r["toe"] is None and r["reason"] == ("too far" if options else "none lower")
    assert {r["line"] for r in got if r["kind"] == "toe"} == set(range(20)) - used and len([r for r in got if r["kind"] == "brow"]) == 25
