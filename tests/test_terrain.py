"""Grid operators against plain restatements on small grids, and a valley from end to end."""

import heapq

import numpy as np
import pytest

from hydrospark.operators import geometry as G
from hydrospark.operators import raster as R
from hydrospark.operators import terrain as T
from hydrospark.plans import basin as P
from hydrospark.plans import inundation as I
from hydrospark.plans import scenario as Sc


def cells(spark, z, name="value"):
    rows = [(int(r), int(c), float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1]) if not np.isnan(z[r, c])]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def grid_of(df, shape, column):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", column).collect():
        out[r[0], r[1]] = r[2]
    return out


def filled_plain(z):
    """Repeated passes of the definition."""
    w = np.full(z.shape, np.inf)
    w[[0, -1], :], w[:, [0, -1]] = z[[0, -1], :], z[:, [0, -1]]
    while True:
        best = np.full(z.shape, np.inf)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                s = np.full(z.shape, np.inf)
                s[max(0, -dr) : z.shape[0] - max(0, dr), max(0, -dc) : z.shape[1] - max(0, dc)] = w[max(0, dr) : z.shape[0] + min(0, dr), max(0, dc) : z.shape[1] + min(0, dc)]
                best = np.minimum(best, s)
        new = np.minimum(w, np.maximum(z, best))
        if np.array_equal(new, w):
            return w
        w = new


def greedy_fill(depth, ground, seeds, budget, area, penalty):
    """The fill told as a walk: always on to the cheapest cell, until the budget is gone."""
    cost, done, out, left = {s: 0.0 for s in seeds if depth[s] > 0}, set(), {}, budget
    heap = [(0.0, *s) for s in cost]
    heapq.heapify(heap)
    while heap and left > 0:
        v, r, c = heapq.heappop(heap)
        if (r, c) in done or v != cost[(r, c)]:
            continue
        done.add((r, c))
        out[(r, c)] = min(depth[r, c], left / area)
        left -= out[(r, c)] * area
        for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= n[0] < depth.shape[0] and 0 <= n[1] < depth.shape[1] and depth[n] > 0 and n not in done:
                new = v + 2.0 * (1 + penalty * max(0.0, ground[n] - ground[r, c]))
                if new < cost.get(n, np.inf):
                    cost[n] = new
                    heapq.heappush(heap, (new, *n))
    return out


def test_fill_depressions(spark):
    z = np.random.default_rng(3).random((23, 17)).round(3)
    out = T.fill_depressions(cells(spark, z), tile=8)
    assert np.allclose(grid_of(out, z.shape, "filled"), filled_plain(z))
    assert out.where("fill_depth < 0").count() == 0


def test_closed_pit(spark):
    z = np.full((7, 7), 5.0)
    z[2:5, 2:5] = 1.0
    z[3, 0:2] = 3.0  # the spill
    assert grid_of(T.fill_depressions(cells(spark, z)), z.shape, "filled")[3, 3] == 3.0


@pytest.mark.parametrize("budget", [0.0, 7.3, 60.0, 1e9])
def test_fill_is_the_greedy_walk(spark, budget):
    rng = np.random.default_rng(11)
    ground = rng.random((14, 11)) * 3
    depth = np.where(rng.random((14, 11)) < 0.75, rng.random((14, 11)), 0.0)
    seeds = [(2, 3), (10, 7)]
    depth[2, 3] = 0.5
    d = cells(spark, depth, "depth").join(cells(spark, ground, "ground"), ["row", "col"])
    s = spark.createDataFrame(seeds, "row int, col int")
    grid = (2.0, 0.0, 0.0, 0.0, -2.0, 0.0)
    got = {(r.row, r.col): r.filled_depth for r in T.volume_limited_fill(d, s, budget, grid=grid).collect()}
    want = greedy_fill(depth, ground, seeds, budget, 4.0, 8.0)
    assert {k: round(v, 9) for k, v in got.items() if v > 0} == {k: round(v, 9) for k, v in want.items() if v > 0}
    assert sum(got.values()) * 4.0 <= budget + 1e-6


@pytest.mark.parametrize("connectivity", [4, 8])
def test_cost_is_that_of_the_whole_grid(spark, connectivity):
    """A maze of walls over many tiles, where cheapest ways wind in and out of tiles; costs are those of one Dijkstra."""
    rng = np.random.default_rng(connectivity)
    z = rng.random((22, 31)).round(3) * 2
    z[3:20, 8] = z[2:21, 16] = z[0:18, 24] = np.nan
    seeds = [(0, 0), (21, 30)]
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (connectivity == 8 or not (dr and dc))]
    cost, heap = dict.fromkeys(seeds, 0.0), [(0.0, *s) for s in seeds]
    while heap:
        v, r, c = heapq.heappop(heap)
        if v > cost[r, c]:
            continue
        for dr, dc in steps:
            i, j = r + dr, c + dc
            if 0 <= i < 22 and 0 <= j < 31 and z[i, j] == z[i, j]:
                new = v + np.hypot(dr * 2.0, dc * 3.0) * (1 + 8.0 * max(0.0, z[i, j] - z[r, c]))
                if new < cost.get((i, j), np.inf):
                    cost[i, j] = new
                    heapq.heappush(heap, (new, i, j))
    grid = (3.0, 0.0, 0.0, 0.0, -2.0, 0.0)
    before = len(spark.catalog.listTables())
    out = T.cost_distance(cells(spark, z), spark.createDataFrame(seeds, "row int, col int"), grid=grid, connectivity=connectivity, tile=7)
    got = {(r.row, r.col): r.cost for r in out.collect()}
    assert got.keys() == cost.keys() and all(abs(got[k] - cost[k]) < 1e-9 for k in cost)
    assert len(spark.catalog.listTables()) == before
    assert T.cost_distance(cells(spark, z), spark.createDataFrame([(99, 99)], "row int, col int"), grid=grid).count() == 0


def test_outlines_and_area(spark):
    mask = np.zeros((6, 7))
    mask[1:5, 1:6] = 1
    mask[2:4, 2:4] = 0  # a hole
    m = cells(spark, np.where(mask > 0, 1.0, np.nan))
    grid = (2.0, 0.0, 10.0, 0.0, -2.0, 20.0)
    rings = G.outlines(m.select("row", "col"), grid)
    assert len(rings.first()["rings"]) == 2
    assert rings.select(G.ring_area()).first()[0] == pytest.approx(mask.sum() * 4.0)
    back = G.cells_near_rings(rings, grid, 6, 7, -1e-9)
    assert R.clip_to_rings(m, rings, grid).count() == mask.sum() and back.count() >= mask.sum()
    box = G.bounds(rings).first()
    assert (box.min_x, box.max_x, box.min_y, box.max_y) == (12.0, 22.0, 10.0, 18.0)


def test_touching_cells(spark):
    """All cells that a shape touches count, with and without a margin."""
    ring = spark.createDataFrame([([[{"x": 1.2, "y": -1.2}, {"x": 2.8, "y": -1.2}, {"x": 2.8, "y": -1.8}, {"x": 1.2, "y": -1.8}, {"x": 1.2, "y": -1.2}]],)], f"rings {G.RINGS}")
    at = lambda m: {(r.row, r.col) for r in G.cells_near_rings(ring, R.UNIT_GRID, 5, 5, m).collect()}
    assert at(0.0) == {(1, 1), (1, 2)}
    assert at(0.25) == {(r, c) for r in range(0, 3) for c in range(0, 4)} - {(0, 0), (0, 3), (2, 0), (2, 3)} | {(0, 1), (2, 1)}


def test_clip_and_simplify(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]
    df = spark.createDataFrame([(1, square)], f"id int, rings {G.RINGS}")
    cut = G.clip_convex(df, [(2, -1), (9, -1), (9, 2), (2, 2)], ["id"])
    assert cut.select(G.ring_area()).first()[0] == pytest.approx(4.0)
    assert G.clip_convex(df, [(20, 20), (21, 20), (21, 21)], ["id"]).count() == 0
    line = [[{"x": float(x), "y": 0.01 * (x % 2)} for x in range(10)] + [{"x": 9.0, "y": 5.0}]]
    assert len(G.simplify(spark.createDataFrame([(1, line)], f"id int, rings {G.RINGS}"), 0.1, ["id"]).first()["rings"][0]) == 3


def valley(n):
    """A V-valley that drains south along the middle column, with a gentle flood plain beyond its banks."""
    r, c = np.mgrid[0:n, 0:n]
    off = np.abs(c - n // 2)
    return 10 + 0.05 * (n - 1 - r) + np.where(off <= 8, 0.35 * off, 2.8 + 0.03 * (off - 8))


def test_valley_from_end_to_end(spark):
    n, grid = 45, (2.0, 0.0, 0.0, 0.0, -2.0, 90.0)
    z = valley(n)
    dem = cells(spark, z)
    mid = (2.0 * (n // 2) + 1.0, 1.0)
    got = P.prepare(dem, grid, n, mid, stream_km2=0.0009, mainstem_km2=0.001, snap_m=20.0)
    main = {(r.row, r.col) for r in got["mainstem"].collect()}
    assert (n - 1, n // 2) in main and all(abs(c - n // 2) <= 1 for _, c in main) and len(main) > 25
    assert got["terrain"].where("hand < -0.01").count() == 0
    assert got["terrain"].where(f"row = {n - 1} and col = {n // 2}").first()["area_km2"] > 0.6 * z.size * 4e-6
    profile = P.bank_profile(got, dem, grid, n, spacing=15.0, half_width=30.0, sample=1.0, reach=(8.0, 26.0), least_relief=4.0)
    rows = profile.orderBy("station_m").collect()
    assert len(rows) >= 4 and all(r.section_id == k for k, r in enumerate(rows))
    sound = [r for r in rows if r.left_bank_distance_m is not None]
    assert len(sound) >= 4
    assert all(r.left_bank_distance_m < 0 < r.right_bank_distance_m for r in sound)
    assert all(r.bankfull_conveyance_index > 0 for r in sound)
    first = rows[0]
    bank = first.lower_bank_final_ft_navd88
    s = I.Screen(grid, n, n, 900.0, bank + 3.0, 300.0, bank, first.routing_channel_elevation_ft_navd88, first.upstream_area_km2, max_hand_m=20.0, min_component_pixels=3, duration_hours=0.05, section_reach_m=80.0)
    out = I.screen(got["terrain"], got["mainstem"], profile, s)
    row = I.summary(out, got["terrain"], s).first()
    assert out["seeds"].count() > 0 and row.potential_pixels > 0
    assert 0 < row.flood_volume_m3 <= out["budget_m3"] + 1e-6
    assert row.flood_pixels <= row.potential_pixels
    assert R.masked(out["depth"], keep=[out["corridor"]]).count() == 0
    storm = Sc.rainfall_hydrograph(spark, profile, rainfall_in=11.0, duration_hours=5.0, basin_sqmi=1.0, wetness="wet").toPandas()
    assert storm.streamflow.max() > 300 and storm.time.is_monotonic_increasing
    with pytest.raises(ValueError, match="positive"):
        Sc.rainfall_hydrograph(spark, profile, rainfall_in=0.0, duration_hours=5.0, basin_sqmi=1.0)


def test_selected_branch(spark):
    from hydrospark.operators import graph as Gr

    # 0 <- 1 <- 2 <- 3 <- 4 with a side arm 2 <- 5 <- 6
    ptr = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, 5)], "id long, ptr long")
    area = Gr.accumulate(ptr)
    assert {r.id: r.total for r in area.collect()} == {0: 7, 1: 6, 2: 5, 3: 2, 4: 1, 5: 2, 6: 1}
    one = lambda k: spark.createDataFrame([(k,)], "id long")
    assert {r.id for r in Gr.selected_branch(ptr, area, one(5), one(0), 1.0).collect()} == {0, 1, 2, 5, 6}
    assert Gr.selected_branch(ptr, area, one(5), one(3), 1.0).count() == 0
    assert [(r.id, r.path_index) for r in Gr.mainstem(ptr, area, one(0), 2.0).orderBy("path_index").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_every_row_is_a_section(spark, sf_dir):
    from hydrospark.queries import terrain_queries as Q

    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    assert {r.section_id for r in Q.find_banks(spark, sf_dir).select("section_id").collect()} == ids
    # Row k of the grid is section k: the corridor touches every row but those beside a section without a bank.
    rows = {r.row for r in Q.corridor(spark, sf_dir).select("row").distinct().collect()}
    assert {i for i in ids if not {k % 40 for k in range(i - 2, i + 3)} & {14}} <= rows
