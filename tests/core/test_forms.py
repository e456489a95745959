"""Nearest sources against brute force, forms of known shape, burned lines."""

import numpy as np
import pytest

from orogen.operators import forms


def grid(spark, ny, nx):
    return spark.createDataFrame([(i, j) for i in range(ny) for j in range(nx)], "row int, col int")


@pytest.mark.parametrize("share", [0.004, 0.03, 0.5])
def test_nearest_sources_equal_brute_force(spark, share):
    rng = np.random.default_rng(int(share * 1000))
    ny, nx = 71, 53
    at = sorted(map(tuple, np.argwhere(rng.random((ny, nx)) < share).tolist())) or [(3, 4)]
    got = forms.nearest_source(grid(spark, ny, nx), spark.createDataFrame(at, "row int, col int"), nx).collect()
    assert len(got) == ny * nx
    for r in got:
        d2, c, i = min(((a - r["row"]) ** 2 + (b - r["col"]) ** 2, b, a) for a, b in at)
        assert r["distance"] == pytest.approx(d2**0.5) and (r["source_row"], r["source_col"]) == (i, c)
    none = forms.nearest_source(grid(spark, 3, 4), spark.createDataFrame([], "row int, col int"), 4).collect()
    assert len(none) == 12 and all(r["distance"] is None and r["source_row"] is None for r in none)


def test_a_cone_between_a_ring_and_its_middle(spark):
    ring = [(0, k, 20 + 12 * np.cos(a), 20 + 12 * np.sin(a), 0.0) for k, a in enumerate(np.linspace(0, 2 * np.pi, 60))]
    schema = "line int, seq int, x double, y double, z double"
    top = forms.burned(spark.createDataFrame([(1, 0, 20.0, 20.0, 10.0)], schema), 41, 41)
    bottom = forms.burned(spark.createDataFrame([tuple(map(float, r)) for r in ring], "line double, seq double, x double, y double, z double"), 41, 41)
    got = {(r["row"], r["col"]): r for r in forms.form_surface(grid(spark, 41, 41), top, bottom, 41).collect()}
    assert got[20, 20]["z"] == 10 and got[20, 32]["z"] == 0 and got[20, 26]["z"] == pytest.approx(5) and got[26, 20]["alpha"] == pytest.approx(0.5, rel=0.03)
    assert got[20, 20]["body"] and got[20, 30]["body"] and not got[0, 0]["body"] and not got[20, 26]["border"]
    assert all(not r["border"] or r["body"] for r in got.values()) and any(r["border"] for r in got.values())
    eased = {(r["row"], r["col"]): r["z"] for r in forms.form_surface(grid(spark, 41, 41), top, bottom, 41, smooth=True).collect()}
    assert eased[20, 23] == pytest.approx(10 * 0.75**2 * 1.5, rel=0.01)
    nothing = forms.form_surface(grid(spark, 5, 5), top.limit(0), bottom.limit(0), 5).collect()
    assert len(nothing) == 25 and not any(r["body"] or r["z"] for r in nothing)


def test_burned_lines_carry_heights(spark):
    got = {(r["row"], r["col"]): r["z"] for r in forms.burned(spark.createDataFrame([(1, 0, 0.0, 2.0, 0.0), (1, 1, 8.0, 2.0, 8.0), (1, 2, 8.0, 99.0, None), (2, 0, 3.0, 2.0, 77.0)], "line int, seq int, x double, y double, z double"), 5, 9).collect()}
    assert set(got) == {(2, c) for c in range(9)} and got[2, 3] == 77 and got[2, 4] in (4.0, 4.5) and got[2, 8] == 8
