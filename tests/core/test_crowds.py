"""Crowded tiles and blocks are split and give the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orogen.functions import joins
from orogen.functions.joins import block_pairs
from orogen.operators import variogram
from orogen.operators.kriging import Model, krige
from orogen.operators.variogram import experimental


def crowd(rng, n):
    """Points of which nine tenths crowd in a hundredth of the ground."""
    x, y = rng.uniform(0, 1000, n), rng.uniform(0, 1000, n)
    x[: n * 9 // 10], y[: n * 9 // 10] = rng.uniform(400, 500, n * 9 // 10), rng.uniform(400, 500, n * 9 // 10)
    return x, y, rng.normal(0, 1, n)


def test_kriging_of_crowds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(*crowd(rng, 500), strict=True))]
    samples = spark.createDataFrame(rows, "id long, x double, y double, v double")
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b, _) in enumerate(zip(*crowd(rng, 1500), strict=True))], "id long, x double, y double")
    model = Model("spherical", 1.0, 80.0, 0.1)
    walls = spark.createDataFrame([(450.0, 390.0, 450.0, 510.0)], "x0 double, y0 double, x1 double, y1 double")
    for faults in (None, walls):
        split, whole = ({r["id"]: r for r in krige(targets, samples, model, 30.0, most=12, least=2, faults=faults, tile=t).collect()} for t in (20, 100_000))
        assert len(split) == len(whole) == 1500
        for k, r in whole.items():
            assert split[k]["n_near"] == r["n_near"] and (split[k]["estimate"] == pytest.approx(r["estimate"]) if r["estimate"] is not None else split[k]["estimate"] is None)


def test_pairs_of_crowds(spark):
    rng = np.random.default_rng(2)
    x, y, v = crowd(rng, 900)
    points = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))], "id long, x double, y double, v double")

    def count(left, right, mask):
        import pandas as pd

        h = np.hypot(np.subtract.outer(np.asarray(left[0], float), np.asarray(right[0], float)), np.subtract.outer(np.asarray(left[1], float), np.asarray(right[1], float))) <= 120
        return pd.DataFrame({"n": [int((h if mask is None else h & mask).sum())]})

    near = np.hypot(np.subtract.outer(x, x), np.subtract.outer(y, y)) <= 120
    want = (int(near.sum()) - len(x)) // 2
    for block in (30, 100_000):
        assert block_pairs(points, 120.0, ["x", "y"], count, "n long", block).agg(F.sum("n")).first()[0] == want
    assert experimental(points, 10, 200.0).agg(F.sum("npairs")).first()[0] == (int((np.hypot(np.subtract.outer(x, x), np.subtract.outer(y, y)) <= 200).sum()) - len(x)) // 2


@pytest.mark.parametrize("weighted", [False, True])
def test_maps_of_whole_blocks_are_those_of_pairs(spark, monkeypatch, weighted):
    """Places on whole metres put many lags on the edges of bins; crowds are dealt into parts."""
    rng = np.random.default_rng(4)
    x, y, v = crowd(rng, 700)
    rows = [(i, float(round(a)), float(round(b)), float(c) + 50, float(rng.integers(1, 4)) if weighted else 1.0) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))]
    points = spark.createDataFrame(rows, "id long, x double, y double, v double, w double")
    points = points if weighted else points.drop("w")
    got = {}
    for least in (1, 1_000_000):
        monkeypatch.setattr(joins, "_WHOLE", least)
        for block in (60, 5000):
            monkeypatch.setattr(variogram, "block_pairs", lambda *a, n=block, **b: block_pairs(*a, block=n, **b))
            got[least, block] = {(r["ix"], r["iy"]): (r["npairs"], r["gamma"]) for r in variogram.surface(points, 10, 300.0, 1).collect()}
    want = got[1_000_000, 5000]
    assert len(want) > 400 and sum(n for n, _ in want.values()) > 100_000
    for other in got.values():
        assert other.keys() == want.keys() and all(other[k][0] == n and other[k][1] == pytest.approx(g, rel=1e-12) for k, (n, g) in want.items())


def test_blocks_are_sent_where_there_are_others(spark, monkeypatch):
    """No point is sent to a block off the ground: of 9 blocks each meets 8 others and itself."""
    sent, kind = [], type(spark.range(0))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda t, *a: sent.append(t.count()) or plain(t, *a))
    points = spark.range(900).select("id", (F.col("id") % 30 * 10.0).alias("x"), (F.floor(F.col("id") / 30) * 10.0).alias("y"), F.lit(1.0).alias("v"))
    assert block_pairs(points, 1000.0, ["x", "y"], lambda a, b, m: np.array([m.sum() if m is not None else len(a[0]) * len(b[0])]), "n long", 100, summed=lambda s: pd.DataFrame({"n": s})).agg(F.sum("n")).first()[0] == 900 * 899 // 2
    assert sent[-1] == 900 * 9
