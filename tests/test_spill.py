"""The spill graph against repeated passes of the definition, over many tiles."""

import numpy as np
import pytest
from test_terrain import cells, filled_plain, grid_of

from hydrospark.operators import spill as S


def plain_with_holes(z):
    """Repeated passes; cells beside a hole or the rim drain at their own height."""
    there = ~np.isnan(z)
    wide = np.pad(there, 1)
    inner = there.copy()
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            inner &= wide[1 + dr : wide.shape[0] - 1 + dr, 1 + dc : wide.shape[1] - 1 + dc]
    w = np.where(there & ~inner, z, np.inf)
    w[~there] = np.nan
    while True:
        p = np.pad(w, 1, constant_values=np.nan)
        near = np.stack([p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
        best = np.nanmin(np.where(np.isnan(near), np.inf, near), axis=0)
        new = np.where(inner, np.minimum(w, np.maximum(z, best)), w)
        if np.array_equal(new, w, equal_nan=True):
            return w
        w = new


@pytest.mark.parametrize("tile, small", [(1, 100_000), (6, 0), (64, 100_000)])
def test_rough_ground_with_ties_and_holes(spark, tile, small):
    rng = np.random.default_rng(tile)
    z = rng.integers(0, 9, (21, 26)).astype(float)
    z[9, 11] = z[3, 4] = np.nan
    z[14:17, 20:] = np.nan
    got = S.fill_depressions(cells(spark, z), tile=tile, small=small)
    assert np.array_equal(grid_of(got, z.shape, "filled"), plain_with_holes(z), equal_nan=True)
    assert got.where("fill_depth < 0 or filled < value").count() == 0


def spiral(n, wall=50.0):
    """One channel that winds from the middle to the rim, falling all the way but for a sill near its end."""
    z = np.full((n, n), wall)
    r = c = n // 2
    way, step, turn = [(r, c)], 2, 0
    while 0 < r < n - 1 and 0 < c < n - 1:
        for _ in range(2):
            dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[turn % 4]
            for _ in range(step):
                r, c = r + dr, c + dc
                if 0 <= r < n and 0 <= c < n:
                    way.append((r, c))
            turn += 1
        step += 2
    way = [p for p in way if 0 <= p[0] < n and 0 <= p[1] < n]
    for k, (i, j) in enumerate(way):
        z[i, j] = 40.0 - 30.0 * k / len(way)
    z[way[-6]] = 45.0
    return z


def test_a_spiral_valley_over_many_tiles(spark):
    z = spiral(60)
    got = grid_of(S.fill_depressions(cells(spark, z), tile=9, small=0), z.shape, "filled")  # 49 tiles
    assert np.array_equal(got, filled_plain(z))
    assert (got == 45.0).sum() > 300


def test_negative_places_missing_values_and_no_cells(spark):
    z = np.random.default_rng(2).random((12, 12)).round(2)
    moved = cells(spark, z).selectExpr("row - 7 as row", "col - 300 as col", "value")
    got = S.fill_depressions(moved, tile=4).selectExpr("row + 7 as row", "col + 300 as col", "filled")
    assert np.array_equal(grid_of(got, z.shape, "filled"), filled_plain(z))
    odd = spark.createDataFrame([(0, 0, None), (0, 1, 2.0)], "row int, col int, value double")
    assert {(r.col, r.filled) for r in S.fill_depressions(odd).collect()} == {(0, None), (1, 2.0)}
    assert S.fill_depressions(odd.where("row = 5")).count() == 0
