"""Accumulation and basins by tiles equal those by pointers, whatever the tiles."""

import numpy as np
import pytest

from orogen.operators import flow
from tests.core.test_belts import frame


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_dont_show(spark, tile):
    rng = np.random.default_rng(tile)
    z = rng.uniform(0, 3, (19, 23)) + np.add.outer(np.arange(19) * 0.7, np.abs(np.arange(23) - 11) * 0.9)  # a valley that winds through many tiles
    z[4, 5] = z[12, 13] = np.nan
    cells, ny, nx = frame(spark, z)
    down = flow.receivers(cells, ny, nx).cache()
    for f, name in ((flow.accumulation, "acc"), (flow.basins, "outlet")):
        want = {r["cell"]: r[name] for r in f(down).collect()}
        assert {r["cell"]: r[name] for r in f(down, nx, tile).collect()} == want and len(want) == 19 * 23 - 2
