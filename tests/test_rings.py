"""Outlines by list ranking: areas, order and closed rings, over many tiles."""

import numpy as np
import pytest
from test_terrain import cells

from hydrospark.operators import rings as G

GRID = (2.0, 0.0, 10.0, 0.0, -2.0, 20.0)


def shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def rings_of(df):
    out = {}
    for r in df.orderBy("ring", "seq").collect():
        out.setdefault(r.ring, []).append((r.seq, r.x, r.y))
    return out


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_random_masks(spark, tile):
    rng = np.random.default_rng(3)
    mask = rng.random((13, 17)) < 0.55
    m = cells(spark, np.where(mask, 1.0, np.nan))
    got = rings_of(G.outline_points(m, GRID, tile=tile))
    total = 0.0
    for points in got.values():
        assert [s for s, _, _ in points] == list(range(len(points)))
        p = [(x, y) for _, x, y in points]
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(p, p[1:] + p[:1]))  # sides go along one axis
        total += shoelace(p)
    assert total == pytest.approx(mask.sum() * 4.0)
    table = {r.ring: (r.n_points, r.area) for r in G.ring_table(m, GRID, tile=tile).collect()}
    assert table == {k: (len(p), pytest.approx(shoelace([(x, y) for _, x, y in p]))) for k, p in got.items()}


def test_same_rings_whatever_the_tiles(spark):
    mask = np.zeros((30, 30), bool)
    mask[2:28, 2:28] = True
    mask[5:9, 6:20] = mask[15:20, 3:7] = False
    mask[20, 20] = False
    m = cells(spark, np.where(mask, 1.0, np.nan))
    as_set = lambda t: {frozenset((x, y) for _, x, y in p) for p in rings_of(G.outline_points(m, GRID, tile=t)).values()}
    assert as_set(3) == as_set(100) and len(as_set(100)) == 4


def test_groups_shapes_and_no_cells(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("b", 0, 2), ("b", 1, 3), (None, 5, 5)]  # b's cells touch at a corner
    m = spark.createDataFrame(rows, "zone string, row int, col int")
    got = {r.zone: r.rings for r in G.outlines(m, GRID, ["zone"]).collect()}
    assert {k: len(v) for k, v in got.items()} == {"a": 1, "b": 2, None: 1}
    assert all(r[0] == r[-1] and len(r) == 5 for v in got.values() for r in v)
    assert G.outlines(m.where("row = 9"), GRID, ["zone"]).count() == 0
    assert {r.zone: r.area for r in G.ring_table(m, GRID, ["zone"]).where("zone is not null").groupBy("zone").agg({"area": "sum"}).withColumnRenamed("sum(area)", "area").collect()} == {"a": 8.0, "b": 8.0}


def test_one_component_is_spread_over_its_tiles(spark):
    """A comb of a third of all cells: no task stitches more than the edges of a tile."""
    mask = np.zeros((60, 60), bool)
    mask[:, ::3] = True
    mask[0, :] = True
    m = cells(spark, np.where(mask, 1.0, np.nan))
    chains = G.ranked_chains(m, tile=10)
    assert chains.select("ring").distinct().count() == 1
    assert chains.count() > 100 and chains.agg({"n": "max"}).first()[0] <= 4 * 100
    (row,) = G.ring_table(m, GRID, tile=10).collect()
    assert row.area == pytest.approx(mask.sum() * 4.0)
