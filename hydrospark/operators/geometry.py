"""Shapes: corridors from sections, outlines of masks, clipping, simplification.

A shape is ``rings``: arrays of arrays of {x, y}, the first and last point of a ring being equal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import series as S
from hydrospark.operators.raster import Grid
from hydrospark.operators.rings import outline_points, outlines, ring_table
from hydrospark.session import ship

RINGS = "array<array<struct<x: double, y: double>>>"


def corridor_quads(profile: DataFrame, by: Sequence[str] = ("workspace_id",), least_pairs: int = 4, least_width: float = 2.0) -> DataFrame:
    """M14 (shapes): a quadrilateral from bank to bank between each section and the next.

    Sections of which a bank is missing, or that are narrower than ``least_width``, take banks
    interpolated along the river; rivers with fewer than ``least_pairs`` sound sections have no
    corridor.
    """
    w = W.partitionBy(*by).orderBy("station_m")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    a, b = X.number("left_bank_distance_m"), X.number("right_bank_distance_m")
    ok = F.coalesce(F.abs(b - a) >= least_width, F.lit(False))
    df = profile.withColumns({"__ok": ok, "__l": F.when(ok, F.least(a, b)), "__r": F.when(ok, F.greatest(a, b))})
    df = df.withColumn("__n", F.sum(F.col("__ok").cast("int")).over(whole)).where(F.col("__n") >= least_pairs)
    size = F.hypot("cross_dx", "cross_dy")
    df = df.withColumns({"__l": S.fill_linear("__l", "station_m", by, "station_m"), "__r": S.fill_linear("__r", "station_m", by, "station_m"), "__dx": X.safe_divide("cross_dx", size), "__dy": X.safe_divide("cross_dy", size)})
    at = lambda d: F.struct((F.col("center_x") + F.col(d) * F.col("__dx")).alias("x"), (F.col("center_y") + F.col(d) * F.col("__dy")).alias("y"))
    df = df.withColumns({"__a": at("__l"), "__b": at("__r")})
    df = df.withColumns({"__c": F.lead("__b").over(w), "__d": F.lead("__a").over(w)}).where("__c is not null")
    return df.select(*by, "station_m", F.array(F.array("__a", "__b", "__c", "__d", "__a")).alias("rings"))


def cells_near_rings(shapes: DataFrame, grid: Grid, nrows: int, ncols: int, buffer_m: float = 0.0) -> DataFrame:
    """M14 (cells): cells whose square comes within ``buffer_m`` of a shape (any touch counts).

    Each shape is laid over the cells of its own box only.  Shapes are dealt to a stated number of tasks, and a cell meets
    the edges of its shape as rows: a river's shapes come from one window, and a lambda over edges is not compiled.
    """
    a, b, c, d, e, f = grid
    corner = lambda fn, axis: fn(F.transform(F.flatten("rings"), lambda p: p[axis]))
    dealt = shapes.select("rings").repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    box = dealt.select("rings", corner(F.array_min, "x").alias("x0"), corner(F.array_max, "x").alias("x1"), corner(F.array_min, "y").alias("y0"), corner(F.array_max, "y").alias("y1"))
    pad = buffer_m + max(abs(a), abs(e))
    lo, hi = X.cell_of(F.col("x0") - pad, F.col("y0") - pad, grid), X.cell_of(F.col("x1") + pad, F.col("y1") + pad, grid)
    span = lambda axis, n: F.sequence(F.greatest(F.least(lo[axis], hi[axis]), F.lit(0)), F.least(F.greatest(lo[axis], hi[axis]), F.lit(n - 1)))
    meets = (F.greatest(lo["row"], hi["row"]) >= 0) & (F.least(lo["row"], hi["row"]) < nrows) & (F.greatest(lo["col"], hi["col"]) >= 0) & (F.least(lo["col"], hi["col"]) < ncols)
    own = lambda ring: F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))
    # The shape's own number tells its cells from those of others.
    laid = box.where(meets).select(F.monotonically_increasing_id().alias("shape"), span("row", nrows).alias("rows"), span("col", ncols).alias("cols"), F.transform("rings", own).alias("edges"))
    sides = laid.select("shape", "rows", "cols", F.posexplode("edges").alias("ring", "es")).select("shape", "rows", "cols", "ring", F.explode("es").alias("e")).select("shape", "rows", "cols", "ring", "e.*")
    met = sides.select("shape", "cols", "ring", "px", "py", "qx", "qy", F.explode("rows").alias("row")).select("shape", "row", "ring", "px", "py", "qx", "qy", F.explode("cols").alias("col"))
    centre = X.cell_center("row", "col", grid)
    met = met.withColumns({"cx": centre["x"], "cy": centre["y"]})
    hx, hy = abs(a) / 2, abs(e) / 2
    cx, cy, px, py, qx, qy = map(F.col, ("cx", "cy", "px", "py", "qx", "qy"))
    dx, dy = qx - px, qy - py
    # Clip the edge to the square (Liang and Barsky): it crosses if an interval is left; else the distance between corners and ends counts.
    t0, t1 = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for step, near, far in ((dx, cx - hx - px, cx + hx - px), (dy, cy - hy - py, cy + hy - py)):
        u, v = F.try_divide(near, step), F.try_divide(far, step)
        t0 = F.greatest(t0, F.coalesce(F.least(u, v), F.lit(0.0)))
        t1 = F.least(t1, F.coalesce(F.greatest(u, v), F.lit(1.0)))
        outside = outside | ((step == 0) & ((near > 0) | (far < 0)))
    crosses = ~outside & (t0 <= t1)
    corners = [X.point_to_segment(cx + sx * hx, cy + sy * hy, px, py, qx, qy) for sx in (-1, 1) for sy in (-1, 1)]
    ends = F.hypot(F.greatest(F.abs(px - cx) - hx, F.lit(0.0)), F.greatest(F.abs(py - cy) - hy, F.lit(0.0)))
    near = (F.col("ring") == 0) & (F.when(crosses, 0.0).otherwise(F.least(*corners, ends)) <= buffer_m)
    # The centre is inside a shape if it lies on an edge, or if an odd number of edges is to its right.
    right = ((py > cy) != (qy > cy)) & (cx < px + (cy - py) * F.try_divide(dx, dy))
    on = (dx * (cy - py) - dy * (cx - px) == 0) & cx.between(F.least(px, qx), F.greatest(px, qx)) & cy.between(F.least(py, qy), F.greatest(py, qy))
    sum_ = met.groupBy("shape", "row", "col").agg(F.max(F.coalesce(near | on, F.lit(False))).alias("near"), F.count_if(F.coalesce(right, F.lit(False))).alias("right"))
    return sum_.where("near or right % 2 = 1").select("row", "col").distinct()


def ring_area(rings: str = "rings"):
    """Area of a shape by the shoelace formula; holes run the other way and count against it."""
    def one(ring):
        cross = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2

    return F.abs(F.aggregate(F.transform(rings, one), F.lit(0.0), lambda s, v: s + v))


def bounds(shapes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The box of all shapes of a group."""
    p = shapes.select(*by, F.explode(F.flatten("rings")).alias("p"))
    return p.groupBy(*by).agg(F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y"))


def union_parts(shapes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The parts of a group as one multipart shape; for tests of touch, which hold for any part."""
    return shapes.groupBy(*by).agg(F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))


def clip_convex(shapes: DataFrame, window: Sequence[tuple[float, float]], keys: Sequence[str] = ()) -> DataFrame:
    """Shapes cut to a convex window (counter-clockwise corners), by Sutherland and Hodgman's method."""
    ship(shapes.sparkSession)
    edges = list(zip(window, [*window[1:], window[0]]))

    def cut(ring):
        pts = [(p["x"], p["y"]) for p in ring][:-1]
        for (ax, ay), (bx, by_) in edges:
            side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)  # noqa: B023, E731
            out = []
            for p, q in zip(pts, pts[1:] + pts[:1]):
                sp, sq = side(p), side(q)
                if sp >= 0:
                    out.append(p)
                if (sp > 0 > sq) or (sp < 0 < sq):
                    t = sp / (sp - sq)
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            pts = out
        return [{"x": float(x), "y": float(y)} for x, y in [*pts, *pts[:1]]] if len(pts) >= 3 else None

    def run(batches):
        for pdf in batches:
            yield pdf.assign(rings=[[r for r in map(cut, rings) if r] for rings in pdf["rings"]])

    kept = shapes.select(*keys, "rings")
    return kept.mapInPandas(run, kept.schema).where(F.size("rings") > 0)


def kept_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay when those within the tolerance of what stays are left out (Douglas and Peucker)."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        v, w = p[j] - p[i], p[i + 1 : j] - p[i]
        size = np.hypot(*v)
        far = np.hypot(*w.T) if size == 0 else np.abs(v[0] * w[:, 1] - v[1] * w[:, 0]) / size
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(shapes: DataFrame, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Lines and rings thinned one by one; ``simplify.simplified`` keeps shared borders shared."""
    ship(shapes.sparkSession)

    def thin(line):
        p = np.array([(q["x"], q["y"]) for q in line], float)
        return [{"x": float(x), "y": float(y)} for x, y in p[kept_points(p, tolerance)]]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(rings=[[thin(r) for r in rings] for rings in pdf["rings"]])

    kept = shapes.select(*keys, "rings")
    return kept.mapInPandas(run, kept.schema)
