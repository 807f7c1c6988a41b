"""Distance to a mask against all pairs."""

import numpy as np
import pytest

from hydrospark.operators import distance as D

GRID = (3.0, 0.0, 0.0, 0.0, -2.0, 0.0)


@pytest.mark.parametrize("share, kept", [(0.02, 1.0), (0.3, 1.0), (0.02, 0.4), (1.0, 0.7)])
def test_against_all_pairs(spark, share, kept):
    rng = np.random.default_rng(int(100 * share + 10 * kept))
    every = [(r, c) for r in range(-4, 17) for c in range(-3, 20)]
    cells = [p for p in every if rng.random() < kept]  # a raster with gaps; masked cells need not be among the cells
    mask = [p for p in every if rng.random() < share] or [(0, 0)]
    got = {(r.row, r.col): r for r in D.distance_to_mask(spark.createDataFrame(cells, "row int, col int"), spark.createDataFrame(mask, "row int, col int"), GRID).collect()}
    assert got.keys() == set(cells)
    for (r, c), x in got.items():
        want = min(np.hypot((r - p) * 2.0, (c - q) * 3.0) for p, q in mask)
        assert x.distance_m == pytest.approx(want)
        assert (x.near_row, x.near_col) in set(mask) and np.hypot((r - x.near_row) * 2.0, (c - x.near_col) * 3.0) == pytest.approx(want)


def test_without_a_mask_and_without_cells(spark):
    one, none = spark.createDataFrame([(1, 2)], "row int, col int"), spark.createDataFrame([], "row int, col int")
    (row,) = D.distance_to_mask(one, none, GRID).collect()
    assert row.near_row is None and (row.distance_m is None or np.isnan(row.distance_m))
    assert D.distance_to_mask(none, one, GRID).count() == 0
