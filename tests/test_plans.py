"""Plans against plain restatements: the screen over the table's valley, curves, ties, late readings, failing sources."""

import heapq
import math
import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import hydraulics as H
from hydrospark.operators import matching as M
from hydrospark.operators import raster as R
from hydrospark.operators import series as S
from hydrospark.functions import columns as X
from hydrospark.plans import bundle as B
from hydrospark.plans import inundation as I
from hydrospark.queries import plan_queries as Q
from hydrospark.sources import payloads as L

NEXT = ((-1, 0), (0, -1), (0, 1), (1, 0))


def table_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", column).collect():
        out[r[0], r[1]] = r[2]
    return out


def test_screen_restated(spark, sf_dir):
    """The whole screen over the valley once more: levels, seeds, connected cells, greedy fill."""
    terrain, mainstem, profile, s = Q._valley(spark, sf_dir)
    shape = (s.nrows, s.ncols)
    ground, hand = table_of(terrain, "ground", shape), table_of(terrain, "hand", shape)
    result = I.screen(terrain, mainstem, profile, s)
    levels = {r.section_id: r for r in result["levels"].collect()}
    # Every row has its section in the middle column, within reach of all its cells; of equal distances the lower row wins.
    wse = np.array([levels[shape[0] - 1 - r].scenario_wse_m_navd88 for r in range(shape[0])])
    over = np.array([levels[shape[0] - 1 - r].local_overtop_ft >= s.overtop_from_ft for r in range(shape[0])])
    depth = wse[:, None] - ground
    corridor = np.zeros(shape, bool)
    for r in result["corridor"].collect():
        corridor[r.row, r.col] = True
    assert corridor[2:-2, 25:41].all() and not corridor[:, :22].any() and not corridor[:, 43:].any()
    open_ = ~corridor
    open_[:, 32] = False
    passable = (hand >= -1e-6) & (hand <= s.max_hand_m)
    base = open_ & passable & (depth >= s.min_depth_m)
    seeds = set()
    for r in range(shape[0]):
        if over[r]:
            for k in range(9):
                c = int((1065.0 + 16.0 + 4.0 + 2.0 * k - 1000.0) // 2.0)
                if c < shape[1] and open_[r, c] and passable[r, c] and depth[r, c] >= s.min_depth_m:
                    seeds.add((r, c))
                    break
    assert {(r.row, r.col) for r in result["seeds"].collect()} == seeds and seeds
    label, potential = np.zeros(shape, bool), np.zeros(shape, bool)
    for start in zip(*np.nonzero(base)):
        if label[start]:
            continue
        part, todo, label[start] = [], deque([start]), True
        while todo:
            r, c = todo.popleft()
            part.append((r, c))
            for dr, dc in NEXT:
                n = (r + dr, c + dc)
                if 0 <= n[0] < shape[0] and 0 <= n[1] < shape[1] and base[n] and not label[n]:
                    label[n] = True
                    todo.append(n)
        near = {(r + dr, c + dc) for r, c in part for dr, dc in (*NEXT, (0, 0))}
        if len(part) >= s.min_component_pixels and near & seeds:
            for p in part:
                potential[p] = True
    assert {(r.row, r.col) for r in result["potential"].select("row", "col").collect()} == set(zip(*map(list, np.nonzero(potential))))
    cost = {p: 0.0 for p in seeds if potential[p]}
    heap, done, left, out = [(0.0, *p) for p in cost], set(), result["budget_m3"], {}
    heapq.heapify(heap)
    while heap and left > 0:
        v, r, c = heapq.heappop(heap)
        if (r, c) in done or v != cost[(r, c)]:
            continue
        done.add((r, c))
        out[(r, c)] = min(depth[r, c], left / 4.0)
        left -= out[(r, c)] * 4.0
        for dr, dc in NEXT:
            n = (r + dr, c + dc)
            if 0 <= n[0] < shape[0] and 0 <= n[1] < shape[1] and potential[n] and n not in done:
                new = v + 2.0 * (1 + s.uphill_penalty * max(0.0, ground[n] - ground[r, c]))
                if new < cost.get(n, np.inf):
                    cost[n] = new
                    heapq.heappush(heap, (new, *n))
    got = {(r.row, r.col): r.depth for r in result["depth"].collect()}
    want = {k: v for k, v in out.items() if v >= s.min_depth_m}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_curves_whose_points_crowd_together(spark):
    """Log-spaced points, more of them than quantiles, against numpy; several curves and one that is a point."""
    x = np.logspace(-3, 5, 500)
    y = np.sqrt(x)
    curve = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", 1.0, 7.0)], "k string, x double, y double")
    q = [0.0, 1e-3, 0.5, 3.0, 1e4, 1e5, 2e6, *map(float, x[::50])]
    probes = spark.createDataFrame([("a", p) for p in q] + [("b", 3.0), ("c", 1.0)], "k string, q double")
    got = {(r.k, r.q): r.v for r in H.interp(probes, curve, "q", "x", "y", "v", ["k"]).collect()}
    assert all(abs(got["a", p] - np.interp(p, x, y)) < 1e-9 for p in q)
    assert got["b", 3.0] == 7.0 and got["c", 1.0] is None


@pytest.mark.parametrize("n, limit", [(1, None), (3, None), (2, 400.0)])
def test_nearest_where_all_features_are_in_one_town(spark, monkeypatch, n, limit):
    """Far points, points in the town and features stacked in one place: few meet, and the nearest are right."""
    monkeypatch.setattr(M, "CROWD", 8)
    rng = random.Random(n)
    feats = [(i, 30.0 + rng.random() / 500, -95.0 + rng.random() / 500) for i in range(400)] + [(1000 + i, 30.001, -95.001) for i in range(60)] + [(2000, -40.0, 179.9)]
    pts = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)] + [(100 + i, 30.0 + rng.random() / 400, -95.0 + rng.random() / 400) for i in range(40)]
    f, p = spark.createDataFrame(feats, "f int, flat double, flon double"), spark.createDataFrame(pts, "p int, lat double, lon double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    got = {}
    for r in M.nearest(p, f, "p", X.haversine_km("lat", "lon", "flat", "flon"), "f", limit=limit, n=n).collect():
        got.setdefault(r.p, []).append((round(r.distance, 6), r.f))
    want = {}
    for i, a, b in pts:
        near = sorted((round(km(a, b, c, d), 6), k) for k, c, d in feats)
        if some := [x for x in near[: n] if limit is None or x[0] <= limit]:
            want[i] = some
    assert {k: sorted(v) for k, v in got.items()} == want


def test_nearest_against_all_pairs(spark):
    """Also across 180 degrees, near a pole, and with fewer features than asked for."""
    rng = random.Random(2)
    spots = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(60)] + [(0.0, 179.9), (0.2, -179.8), (89.5, 10.0), (89.6, -170.0), (-45.0, 100.0)]
    points = [(rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2)) for _ in range(40)] + [(0.1, -179.95), (0.1, 179.99), (89.9, 95.0), (-80.0, 0.0)]
    f = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)], "f int, flat double, flon double")
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "p int, lat double, lon double")
    km = X.haversine_km("lat", "lon", "flat", "flon")
    every = {}
    for r in p.crossJoin(f).select("p", "f", km.alias("d")).collect():
        every.setdefault(r.p, []).append((r.d, r.f))
    for n, limit in ((1, None), (3, None), (1, 50.0), (70, None)):
        got = {}
        for r in M.nearest(p, f, "p", km, "f", limit=limit, n=n).collect():
            got.setdefault(r.p, []).append((r.distance, r.f))
        want = {k: [x for x in sorted(v)[:n] if limit is None or x[0] <= limit] for k, v in every.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_flat_ground_is_not_one_partition(spark):
    cells = spark.range(4000).select((F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("depth"))
    got = {(r.row, r.col) for r in R.running_fill(cells, 1234.0, "cost", "depth", parts=8).collect()}
    assert got == {(k // 50, k % 50) for k in range(1234)}


def test_long_series_take_linear_time(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 1000 == 0, F.rand(1)).alias("x"))
        began = time.perf_counter()
        df.select(S.fill_linear("x", "t", ["g"], "t").alias("v")).agg(F.sum("v")).collect()
        return time.perf_counter() - began

    seconds(1000)
    a, b = seconds(100_000), seconds(400_000)
    assert b < 10 * max(a, 1.0)


def test_asof_over_spans(spark):
    rng = random.Random(5)
    left = [("a", rng.randrange(0, 400_000) / 10) for _ in range(150)]
    right = [("a", rng.randrange(0, 400_000) / 10, float(i)) for i in range(60)]
    l = spark.createDataFrame(left, "g string, t double").select("g", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("time"), "t")
    r = spark.createDataFrame(right, "g string, t double, v double").select("g", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("time"), "v")
    got = sorted((x.t, x.v_nearest) for x in S.asof_nearest(l, r, "v", ["g"], tolerance_seconds=300.0).collect())
    want = []
    for _, t in left:
        near = min(right, key=lambda x: (abs(round(x[1] - t, 6)), x[1]))
        if abs(round(near[1] - t, 6)) <= 300.0:
            want.append((t, near[2]))
    assert got == sorted(want)


def test_json_of_any_depth(spark):
    deep = '{"a":' * 12 + '{"validTime":"2024-01-01T00:00:00Z","streamflow":5,"s":"}}]\\"{"}' + "}" * 12
    pages = spark.createDataFrame([(deep,), ("[" * 9 + '{"time":"2024-01-02T00:00:00Z","flow":6}' + "]" * 9,), ("{broken",), (None,)], "payload string")
    assert sorted(r.streamflow for r in L.streamflow(pages).collect()) == [5.0, 6.0]


def test_one_reference_system(spark):
    tiles = spark.createDataFrame([("EPSG:26915",), ("EPSG:26915",)], "crs string")
    assert R.check_crs(tiles) == "EPSG:26915"
    with pytest.raises(ValueError, match="one reference system"):
        R.check_crs(tiles.unionByName(spark.createDataFrame([("EPSG:4326",)], "crs string")))


def test_a_refresh_keeps_what_it_does_not_ask_for(spark):
    one = lambda n: lambda: spark.range(n).agg(F.count("*").alias("n"))
    before = B.bundle(spark, {"history": one(3), "live": one(4)})
    after = {r.source: r for r in B.bundle(spark, {"live": lambda: spark.read.parquet("/no/such/path")}, before).collect()}
    assert after["history"].figures == {"n": "3"} and after["live"].figures == {} and "no/such/path" in after["live"].error


def test_gauges_may_differ_by_river(spark, sf_dir):
    from hydrospark.queries import hydraulic_queries as Hq

    cap = Hq._capacity(spark, sf_dir)
    plain = H.section_levels(cap, 420.0, 39.5, 200.0, 37.0, 30.0, 70.0)
    by_river = cap.withColumns({"q": F.when(F.col("workspace_id") % 2 == 0, 420.0).otherwise(150.0), "st": F.lit(39.5)})
    mixed = H.section_levels(by_river, "q", "st", 200.0, 37.0, 30.0, 70.0)
    key = ["workspace_id", "section_id", "scenario_wse_ft_navd88", "local_overtop_ft"]
    assert sorted(map(tuple, plain.where("workspace_id % 2 = 0").select(key).collect())) == sorted(map(tuple, mixed.where("workspace_id % 2 = 0").select(key).collect()))
