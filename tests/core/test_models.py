"""Nested structures, the power model and tables of variogram models."""

import numpy as np
import pytest

from orogen.operators.kriging import CEILING, Model, krige
from orogen.sources import tables


def by_hand(tx, ty, x, y, v, cov, top):
    """Ordinary kriging of one target by its own system."""
    n = len(x)
    a, b = np.ones((n + 1, n + 1)), np.ones(n + 1)
    a[n, n] = 0
    for i in range(n):
        for j in range(n):
            a[i, j] = top if i == j else cov(np.hypot(x[i] - x[j], y[i] - y[j]))
        b[i] = cov(np.hypot(x[i] - tx, y[i] - ty))
    w = np.linalg.solve(a, b)
    return w[:n] @ v, top - w @ b


def test_two_spherical_structures_equal_a_hand_solved_system(spark):
    rng = np.random.default_rng(5)
    x, y, v = rng.uniform(0, 100, 9), rng.uniform(0, 100, 9), rng.normal(5, 2, 9)
    sph = lambda h, c, a: c * (1 - 1.5 * h / a + 0.5 * (h / a) ** 3) if h < a else 0.0
    samples = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))], "id long, x double, y double, v double")
    target = spark.createDataFrame([(1, 40.0, 55.0)], "id long, x double, y double")
    got = krige(target, samples, Model("spherical", 2.0, 60.0, 0.3, nested=(Model("spherical", 1.5, 200.0),)), 500.0).first()
    want = by_hand(40, 55, x, y, v, lambda h: sph(h, 2, 60) + sph(h, 1.5, 200), 3.8)
    assert (got["estimate"], got["variance"]) == pytest.approx(want)
    got = krige(target, samples, Model("power", 0.5, 7.0, 0.1, nested=(Model("exponential", 1.0, 30.0),)), 500.0).first()  # the exponent is held at 1.999
    want = by_hand(40, 55, x, y, v, lambda h: CEILING - 0.5 * h**1.999 + np.exp(-h / 30), CEILING + 1.1)
    assert (got["estimate"], got["variance"]) == pytest.approx(want, rel=1e-5)
    assert Model("gaussian", 2.0, 5.0).top == pytest.approx(2.02) and Model("spherical", 1.0, 5.0, 0.0, nested=(Model("gaussian", 3.0, 9.0),)).floor == pytest.approx(0.03)


def test_variogram_tables(spark):
    rows = [
        (1, "Ni", 1, "sph", "2,5", "100", "30", "0,5", "0.2"), (2, " Ni ", 2, "Гауссова", "1", "300", None, "-1", "0.7"), (3, "Ni", 2, "exp", "1", "50", None, None, None),
        (4, "", 1, "sph", "1", "1", None, None, None), (5, "Cu", 1, "cubic", "1", "1", None, None, None), (6, "Cu", 1, "pow", "-1", "1", None, None, None),
        (7, "Cu", 1, "4", "1", "0", None, None, None), (8, "Co", None, "POW", "1", "1.5", None, None, None),
    ]
    table = spark.createDataFrame(rows, "seq int, Profile string, struct int, MODEL string, sill string, `range` string, azimuth string, anis string, nugget string")
    found = tables.variogram_structures(table)
    notes = {r["seq"]: (r["kind"], r["note"]) for r in found.collect()}
    assert notes[1] == ("spherical", None) and notes[2] == ("gaussian", "nugget differs from the profile's first") and notes[3] == (None, "structure stands twice")
    assert [notes[k][1] for k in (4, 5, 6, 7)] == ["no profile", "unknown model", "sill isn't 0 or more", "range isn't above 0"] and notes[8] == ("power", None)
    models = tables.variogram_models(found)
    assert set(models) == {"Ni", "Co"} and models["Co"] == Model("power", 1.0, 1.5)
    assert models["Ni"] == Model("spherical", 2.5, 100.0, 0.2, 30.0, 0.5, (Model("gaussian", 1.0, 300.0, 0.2),))
