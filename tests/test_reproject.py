"""A raster in another reference system, cell by cell."""

import math

import numpy as np
import pytest
from test_terrain import cells

from hydrospark.operators import raster as R

SOURCE, TARGET = (1.0, 0.0, -20.0, 0.0, -1.0, 30.0), (1.3, 0.0, -60.0, 0.0, -1.3, 60.0)


def turned(by):
    c, s = math.cos(by), math.sin(by)
    return lambda x, y: (x * c - y * s, x * s + y * c)


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_a_turned_raster(spark, method):
    z = np.random.default_rng(1).random((23, 31))
    z[5:9, 4:8] = np.nan
    there, back = turned(0.6), turned(-0.6)
    out = R.reproject(cells(spark, z), SOURCE, TARGET, there, back, method=method, tile=8)
    got = {(r.row, r.col): r.value for r in out.collect()}
    want = {}
    for r in range(-20, 120):
        for c in range(-20, 140):
            x, y = back(-60.0 + (c + 0.5) * 1.3, 60.0 - (r + 0.5) * 1.3)
            u, v = x + 20.0, 30.0 - y
            if method == "nearest":
                near = [(math.floor(v), math.floor(u), 1.0)]
            else:
                i, j = math.floor(v - 0.5), math.floor(u - 0.5)
                fv, fu = v - 0.5 - i, u - 0.5 - j
                near = [(i + a, j + b, (fv if a else 1 - fv) * (fu if b else 1 - fu)) for a in (0, 1) for b in (0, 1)]
            some = [(z[a, b], w) for a, b, w in near if 0 <= a < 23 and 0 <= b < 31 and z[a, b] == z[a, b] and w > 0]
            if some:
                want[r, c] = sum(a * w for a, w in some) / sum(w for _, w in some)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_cells(spark):
    none = spark.createDataFrame([], "row int, col int, value double")
    assert R.reproject(none, SOURCE, TARGET, turned(0.1), turned(-0.1)).count() == 0
