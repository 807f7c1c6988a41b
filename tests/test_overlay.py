"""Overlay of polygons: closed forms, places in random polygons, tiles of bounded load."""

import math

import numpy as np
import pytest

from hydrospark.operators import geometry as G
from hydrospark.operators import overlay as O

ROWS = "k string, rings array<array<struct<x:double,y:double>>>"


def shape(spark, *rows):
    return spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in [*r, r[0]]] for r in rings]) for k, rings in rows], ROWS)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize("tile", [1.7, 4.0, 100.0])
def test_closed_forms(spark, tile):
    left = shape(spark, ("a", [box(0, 0, 10, 10), box(2, 2, 4, 4)]), ("a", [box(5, 5, 15, 8)]), ("b", [[(0, 0), (4, 0), (0, 4)]]))
    right = shape(spark, ("r", [box(3, 3, 6, 20)]), ("r", [[(0, 0), (2, 0), (0, 2)]]))
    got = {r.k: r for r in O.overlay_areas(left, right, ["k"], tile).collect()}
    assert got["a"].left_area == pytest.approx(96 + 15) and got["a"].shared_area == pytest.approx(3 * 7 - 1 + 2)
    assert got["b"].left_area == pytest.approx(8) and got["b"].shared_area == pytest.approx(2) and got["b"].left_only_area == pytest.approx(6)
    one = O.overlay_areas(left, right, (), tile).first()
    # b lies in a, whose hole it only touches at (2, 2).
    assert one.left_area == pytest.approx(111) and one.right_area == pytest.approx(51 + 2)
    assert one.union_area == pytest.approx(one.left_area + one.right_area - one.shared_area)


def star(rng, n, cx, cy):
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = rng.uniform(1, 6, n)
    return list(zip(cx + r * np.cos(a), cy + r * np.sin(a)))


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


@pytest.mark.parametrize("tile, most", [(3.1, 512), (50.0, 20), (50.0, 10_000)])
def test_places_in_random_polygons(spark, tile, most):
    rng = np.random.default_rng(11)
    rows = [(f"s{k}", [star(rng, 9, *rng.uniform(-8, 8, 2))]) for k in range(8)]
    # One that crosses itself, and one with a hole that reaches out of it.
    rows += [("x", [[(-5, -5), (5, 5), (5, -5), (-5, 5)]]), ("h", [box(-4, -4, 3, 3), box(1, 1, 6, 6)])]
    left, right = rows[::2], rows[1::2]
    got = O.trapezoids(shape(spark, *left), shape(spark, *right), (), tile, most).collect()
    for x, y in rng.uniform(-15, 15, (1500, 2)):
        on = []
        for t in got:
            if t.y0 <= y < t.y1:
                s = (y - t.y0) / (t.y1 - t.y0)
                if t.left0 + s * (t.left1 - t.left0) <= x < t.right0 + s * (t.right1 - t.right0):
                    on.append((t.in_left, t.in_right))
        want = tuple(any(inside(r, x, y) for _, r in side) for side in (left, right))
        assert on == ([want] if any(want) else [])


def test_clip_dissolve_and_odd_rows(spark):
    odd = spark.createDataFrame([(None, None), ("n", []), ("n", [[(0.0, 0.0), (1.0, 1.0)]]), ("n", [[(0.0, 0.0), (float("nan"), 1.0), (1.0, 0.0), (0.0, 0.0)]]), (None, [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]])], ROWS)
    assert [(r.k, r.left_area, r.shared_area) for r in O.overlay_areas(odd, odd, ["k"], 10.0).collect()] == [(None, pytest.approx(4), pytest.approx(4))]
    none = odd.where("k = 'zz'")
    assert O.overlay_areas(none, none, ["k"]).count() == 0 and O.overlay_areas(none, none).first().union_area == 0.0
    copies = shape(spark, *[("c", [box(0, 0, 3, 3)])] * 40, ("d", [[(-1, 1), (4, 1), (1.5, 4)]]))
    parts = O.dissolve(copies, ["k"], 2.0)
    area = {r.k: r.a for r in parts.withColumn("a", G.ring_area()).groupBy("k").agg({"a": "sum"}).withColumnRenamed("sum(a)", "a").collect()}
    assert area == {"c": pytest.approx(9), "d": pytest.approx(7.5)}
    cut = O.clip(copies, shape(spark, ("w", [box(1, 0, 2, 9)])), ["k"], 2.0).withColumn("a", G.ring_area())
    assert {r.k: r["sum(a)"] for r in cut.groupBy("k").agg({"a": "sum"}).collect()} == {"c": pytest.approx(3), "d": pytest.approx((2.4 + 3.0) / 2)}  # the triangle is 2.4 tall at both sides of the window, 3.0 in its middle


def test_a_crowd_is_quartered(spark):
    """A town of 1,200 small boxes in one tile, many of them copies: no tile is left with more than the edges allowed."""
    rng = np.random.default_rng(2)
    rows = [(str(k % 3), [box(*(c := rng.integers(0, 40, 2)), *(c + rng.integers(1, 4, 2)))]) for k in range(800)] + [("0", [box(5, 5, 7, 7)])] * 400
    cells = {g: set() for g in "012"}
    for g, ((p, _, q, _),) in rows:
        cells[g] |= {(x, y) for x in range(p[0], q[0]) for y in range(p[1], q[1])}
    got = {r.k: r.left_area for r in O.overlay_areas(shape(spark, *rows), shape(spark, ("w", [box(0, 0, 9, 9)])), ["k"], 64.0, 128).collect()}
    assert got == {g: pytest.approx(len(c)) for g, c in cells.items()}
