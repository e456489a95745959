"""Break lines of a synthetic bench, thinning across tiles, hysteresis and patches against brute force."""

import numpy as np
import pytest

from orogen.operators import breaks, raster
from tests.core.test_belts import frame


def cells_of(spark, mask):
    return spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(mask)], "row int, col int")


def mask_of(frame, shape):
    out = np.zeros(shape, bool)
    for r in frame.collect():
        out[r["row"], r["col"]] = True
    return out


def parts(mask):
    """Label of each cell: the first cell, in row order, that it hangs together with."""
    label, nx = {}, mask.shape[1]
    for start in map(tuple, np.argwhere(mask)):
        if start in label:
            continue
        todo, label[start] = [start], int(start[0] * nx + start[1])
        while todo:
            i, j = todo.pop()
            for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < nx and mask[p] and p not in label:
                    label[p] = label[start]
                    todo.append(p)
    return label


def test_patches_and_hysteresis(spark):
    rng = np.random.default_rng(1)
    field = rng.random((23, 26))
    weak, strong = field > 0.55, field > 0.97
    want = parts(weak)
    got = {(r["row"], r["col"]): r["patch"] for r in raster.patches(cells_of(spark, weak), 23, 26, tile=7).collect()}
    assert got == want
    seeds = {want[tuple(p)] for p in np.argwhere(strong)}
    kept = mask_of(breaks.hysteresis(cells_of(spark, weak), cells_of(spark, strong), 23, 26), field.shape)
    assert {tuple(map(int, p)) for p in np.argwhere(kept)} == {p for p, k in want.items() if k in seeds}
    assert raster.patches(cells_of(spark, weak & False), 23, 26).count() == 0


def test_thinning_doesnt_show_tiles_and_keeps_parts(spark):
    y, x = np.mgrid[0:40, 0:44]
    mask = (np.abs(np.hypot(x - 20, y - 19) - 13) < 2.6) | (np.abs(y - x * 0.7 - 3) < 2) | ((x > 36) & (y > 30))
    whole = mask_of(breaks.thinned(cells_of(spark, mask), tile=64), mask.shape)
    tiled = mask_of(breaks.thinned(cells_of(spark, mask), tile=9, turns=1), mask.shape)
    assert (whole == tiled).all() and not (whole & ~mask).any()
    assert len(set(parts(whole).values())) == len(set(parts(mask).values()))
    assert not (whole[:-1, :-1] & whole[1:, :-1] & whole[:-1, 1:] & whole[1:, 1:]).any()


def test_traces_follow_lines_and_rings(spark):
    mask = np.zeros((12, 14), bool)
    mask[2, 1:12] = True  # a line crossed by another, and a ring
    mask[0:6, 5] = True
    for i, j in ((7, 8), (8, 7), (9, 7), (10, 8), (10, 9), (9, 10), (8, 10), (7, 9)):
        mask[i, j] = True
    got = breaks.traced(cells_of(spark, mask), 14).toPandas().sort_values(["line", "seq"])
    lines = sorted((len(g), bool(g["closed"].iloc[0])) for _, g in got.groupby("line"))
    assert (11, False) in lines and (6, False) in lines and (9, True) in lines
    for _, g in got.groupby("line"):
        assert (np.maximum(g["row"].diff().abs(), g["col"].diff().abs()).iloc[1:] == 1).all()


@pytest.mark.parametrize("turned", [False, True])
def test_a_bench_has_one_line_a_side(spark, turned):
    x = np.mgrid[0:60, 0:70][1] if not turned else np.mgrid[0:60, 0:70][0]
    at = 30 if not turned else 28
    z = np.clip((x - at) * -1.0, -10, 0) + 20  # level, a slope of ten cells, level again
    cells, ny, nx = frame(spark, z)
    lines, told = breaks.break_lines(cells, ny, nx, 1.0, 0.5, 8)
    got = told.toPandas()
    assert sorted(got["kind"]) == ["brow", "toe"] and (got["drop"] > 1).all() and (got["n_cells"] > 40).all()
    where = lines.toPandas().merge(got[["line", "kind"]], on="line").groupby("kind")["row" if turned else "col"].median()
    assert abs(where["brow"] - at) <= 1 and abs(where["toe"] - at - 10) <= 1
    flat, _ = breaks.break_lines(*frame(spark, np.mgrid[0:20, 0:20][1] * 0.3), 1.0)
    assert flat.count() == 0
