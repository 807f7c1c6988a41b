"""Simplification with shared borders: no gaps, no crossings, each border within the tolerance."""

import numpy as np
import pytest

from hydrospark.operators import geometry as G
from hydrospark.operators import overlay as O
from hydrospark.operators import simplify as S

ROWS = f"k string, rings {G.RINGS}"


def shapes(spark, rows):
    return spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in rows], ROWS)


def tessellation(rng, n=4, steps=12, wild=2.0):
    """n x n patches of 10 units whose borders wiggle; corners are common to four."""
    def way(a, b):
        a, b = np.array(a, float), np.array(b, float)
        t = np.linspace(0, 1, steps + 1)[1:-1, None]
        return [tuple(a), *map(tuple, a + t * (b - a) + rng.normal(0, wild * 0.1, (steps - 1, 2)) + 0), tuple(b)]

    across = {(i, j): way((10 * i, 10 * j), (10 * i + 10, 10 * j)) for i in range(n) for j in range(n + 1)}
    up = {(i, j): way((10 * i, 10 * j), (10 * i, 10 * j + 10)) for i in range(n + 1) for j in range(n)}
    rows = []
    for i in range(n):
        for j in range(n):
            ring = across[i, j] + up[i + 1, j][1:] + across[i, j + 1][::-1][1:] + up[i, j][::-1][1:]
            k = int(rng.integers(len(ring) - 1))  # neighbours need not begin at a corner
            rows.append((f"{i},{j}", [ring[k:-1] + ring[:k] + [ring[k]]]))
    return rows


def test_a_tessellation_stays_one(spark):
    rng = np.random.default_rng(4)
    df = shapes(spark, tessellation(rng))
    got = S.simplified(df, 0.6, ["k"])
    before, after = ({r.k: r.rings[0] for r in d.collect()} for d in (df, got))
    assert set(before) == set(after) and sum(map(len, after.values())) < 0.5 * sum(map(len, before.values()))
    # Every side is in two patches, but for those of the outer border: no gaps.
    sides = {}
    for ring in after.values():
        assert ring[0] == ring[-1]
        for a, b in zip(ring, ring[1:]):
            sides.setdefault(frozenset((tuple(a), tuple(b))), []).append(1)
    assert {len(v) for v in sides.values()} == {1, 2}
    one = G.ring_area()
    total = got.select(one.alias("a")).agg({"a": "sum"}).first()[0]
    assert O.overlay_areas(got, got, (), 50.0).first().union_area == pytest.approx(total)  # no overlaps
    # Points that went are within the tolerance of what stays.
    for k, ring in before.items():
        line = np.array([tuple(p) for p in after[k]])
        for p in ring:
            a, v = line[:-1], np.diff(line, axis=0)
            t = np.clip(((np.array(p) - a) * v).sum(1) / (v * v).sum(1), 0, 1)
            assert np.hypot(*(a + t[:, None] * v - np.array(p)).T).min() <= 0.6 + 1e-9


def test_thin_necks_and_islands_are_not_crossed(spark):
    # A bay with an island in it: plain thinning by 3 would cut the bay off and leave the island outside.
    coast = [(0, 0), (20, 0), (20, 10), (11, 10), (10.5, 7.5), (9.5, 7.5), (9, 10), (0, 10), (0, 0)]
    island = [(9.8, 9), (10.2, 9), (10.2, 9.4), (9.8, 9.4), (9.8, 9)]
    df = shapes(spark, [("land", [coast]), ("isle", [island]), ("far", [[(x + 50, y) for x, y in coast]])])
    got = {r.k: r.rings[0] for r in S.simplified(df, 3.0, ["k"]).collect()}
    assert len(got["isle"]) >= 4
    assert len(got["far"]) < len(got["land"])  # without an island the bay goes
    area = O.overlay_areas(shapes(spark, [("l", [[tuple(p) for p in got["land"]]])]), shapes(spark, [("i", [[tuple(p) for p in got["isle"]]])]), (), 50.0).first()
    assert area.shared_area == 0.0


def test_lines_repeated_rows_and_odd_points(spark):
    rows = [("line", [[(0, 0), (1, 0.01), (2, 0), (2, 0), (3, 0.01), (4, 0)]])] * 2 + [("two", [[(9, 9), (12, 9)]])]
    df = shapes(spark, rows).unionByName(spark.createDataFrame([("none", None), ("one", [[(1.0, 1.0)]])], ROWS))
    got = {r.k: [[tuple(p) for p in ring] for ring in r.rings] for r in S.simplified(df, 0.1, ["k"]).collect()}
    assert got == {"line": [[(0.0, 0.0), (4.0, 0.0)]], "two": [[(9.0, 9.0), (12.0, 9.0)]]}
    assert S.simplified(df.where("k = 'zz'"), 0.1, ["k"]).count() == 0


def test_strips_of_the_grid(spark, sf_dir):
    """The registered query against lines thinned one by one: an outer line is one arc with its strip's sides."""
    from hydrospark.queries import terrain_queries as T

    e = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    lines = [np.array([(2.0 * i, 10.0 * k + v) for i, v in enumerate(row)]) for k, row in e]
    n = len(lines)
    low = np.vstack([lines[1][:1], lines[0], lines[1][-1:]])
    high = np.vstack([lines[n - 2][:1], lines[n - 1], lines[n - 2][-1:]])
    thin = lambda p: p[G.kept_points(p if tuple(map(tuple, p)) <= tuple(map(tuple, p[::-1])) else p[::-1], 0.1)[:: 1 if tuple(map(tuple, p)) <= tuple(map(tuple, p[::-1])) else -1]]
    kept = [thin(low), *map(thin, lines[1:-1]), thin(high)]
    want = {}
    for k in range(n - 1):
        p = np.vstack([kept[k], kept[k + 1][::-1]])
        p = np.array([q for i, q in enumerate(p) if i == 0 or (q != p[i - 1]).any()])
        if (p[0] == p[-1]).all():
            p = p[:-1]
        x, y = p.T
        want[k] = (len(p) + 1, round(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2, 4))
    got = {r.vec_id: (r.n_points, r.area) for r in T.simplify(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert [(k, got[k], want[k]) for k in want if got[k][0] != want[k][0] or got[k][1] != pytest.approx(want[k][1], abs=2e-3)] == []
