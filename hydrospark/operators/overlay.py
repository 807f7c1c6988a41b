"""Overlay of polygons of any form, with holes, in tiles of bounded load.

A shape is a row with ``rings``; a place is in it if an odd number of its rings go around it, and in a layer if it is in
one of the layer's shapes.  Shapes are cut to tiles, tiles that many edges cross are halved both ways, and in each
tile a sweep splits edges where they meet and gives trapezoids that lie in one layer, the other or both.  Equal
pieces in a tile count once, and a piece that fills its tile stands for all others of its layer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.graph import checkpointed
from hydrospark.operators.rings import _named
from hydrospark.session import ship

_RINGS = "array<array<struct<x:double,y:double>>>"
_PIECES = f"g string, layer int, level int, tx long, ty long, rings {_RINGS}, n long"
_OUT = "g string, in_left boolean, in_right boolean, y0 double, y1 double, left0 double, right0 double, left1 double, right1 double"
_TILE = ["level", "tx", "ty"]


def _half(ring: np.ndarray, axis: int, at: float, below: bool) -> np.ndarray:
    """The part of a ring on one side of a line along an axis; ways back run on the line and cancel out."""
    v = (ring[:, axis] - at) * (1 if below else -1)
    q, w = np.roll(ring, -1, axis=0), np.roll(v, -1)
    crosses = ((v < 0) & (w > 0)) | ((v > 0) & (w < 0))
    t = np.divide(v, v - w, out=np.zeros_like(v), where=crosses)
    meets = ring + t[:, None] * (q - ring)
    meets[:, axis] = at
    return np.stack([ring, meets], 1).reshape(-1, 2)[np.stack([v <= 0, crosses], 1).ravel()]


def _sound(rings: list[np.ndarray]) -> list[np.ndarray]:
    return [r for r in rings if len(r) >= 3 and (np.ptp(r, axis=0) > 0).all()]


def _cut(rings: list[np.ndarray], size: float, box: tuple[int, int, int, int]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Pieces ``(tx, ty, rings)`` of a shape in the tiles of a box of tiles, halving the box."""
    todo = [(rings, box)]
    while todo:
        some, (x0, y0, x1, y1) = todo.pop()
        if not some:
            continue
        if x1 - x0 <= 1 and y1 - y0 <= 1:
            yield x0, y0, some
        elif x1 - x0 >= y1 - y0:
            m = (x0 + x1) // 2
            todo += [(_sound([_half(r, 0, m * size, True) for r in some]), (x0, y0, m, y1)), (_sound([_half(r, 0, m * size, False) for r in some]), (m, y0, x1, y1))]
        else:
            m = (y0 + y1) // 2
            todo += [(_sound([_half(r, 1, m * size, True) for r in some]), (x0, y0, x1, m)), (_sound([_half(r, 1, m * size, False) for r in some]), (x0, m, x1, y1))]


def _points(rings) -> list[np.ndarray]:
    """A row's rings as arrays; a ring with a missing or non-finite point is none."""
    out = []
    for ring in rings if rings is not None else ():
        p = [(q["x"], q["y"]) if q is not None else (None, None) for q in ring] if ring is not None else []
        a = np.array(p, float).reshape(-1, 2)
        if len(a) and np.isfinite(a).all():
            out.append(a[:-1] if len(a) > 1 and (a[0] == a[-1]).all() else a)
    return _sound(out)


def _row(rings: list[np.ndarray], size: float, tx: int, ty: int) -> tuple[list, int]:
    """Rings as Spark takes them; a piece that is its whole tile is always written the same way."""
    x0, y0, x1, y1 = tx * size, ty * size, (tx + 1) * size, (ty + 1) * size
    if len(rings) == 1 and np.isin(rings[0][:, 0], (x0, x1)).all() and np.isin(rings[0][:, 1], (y0, y1)).all() and len(np.unique(rings[0], axis=0)) == 4:
        rings = [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], sum(map(len, rings))


def _batched(rows: Iterator[tuple], names: Sequence[str], size: int = 5_000) -> Iterator[pd.DataFrame]:
    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield pd.DataFrame(some, columns=names)
            some = []
    if some:
        yield pd.DataFrame(some, columns=names)


_PIECE_NAMES = ["g", "layer", "level", "tx", "ty", "rings", "n"]


def _dealt(shapes: DataFrame, tile: float) -> DataFrame:
    """Shapes ``g, layer, rings`` as pieces in tiles."""

    def rows(batches):
        for pdf in batches:
            for g, layer, rings in pdf[["g", "layer", "rings"]].itertuples(index=False, name=None):
                p = _points(rings)
                if p:
                    lo, hi = np.min([r.min(axis=0) for r in p], axis=0), np.max([r.max(axis=0) for r in p], axis=0)
                    box = (*(int(k) for k in np.floor(lo / tile)), *(int(k) + 1 for k in np.floor(hi / tile)))
                    for tx, ty, some in _cut(p, tile, box):
                        yield (g, layer, 0, tx, ty, *_row(some, tile, tx, ty))

    return shapes.mapInPandas(lambda batches: _batched(rows(batches), _PIECE_NAMES), _PIECES)


def _quartered(pieces: DataFrame, tile: float) -> DataFrame:
    def rows(batches):
        for pdf in batches:
            for g, layer, level, tx, ty, rings in pdf[["g", "layer", "level", "tx", "ty", "rings"]].itertuples(index=False, name=None):
                size = tile / 2 ** (level + 1)
                for x, y, some in _cut(_points(rings), size, (2 * tx, 2 * ty, 2 * tx + 2, 2 * ty + 2)):
                    yield (g, layer, level + 1, x, y, *_row(some, size, x, y))

    return pieces.mapInPandas(lambda batches: _batched(rows(batches), _PIECE_NAMES), _PIECES)


def _sweep(shapes: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    """Trapezoids ``(in_left, in_right, y0, y1, left0, right0, left1, right1)`` of a tile's pieces ``(layer, rings)``."""
    starts, ends, owner = [], [], []
    for s, (_, rings) in enumerate(shapes):
        for r in rings:
            starts.append(r)
            ends.append(np.roll(r, -1, axis=0))
            owner += [s] * len(r)
    p, q, owner = np.concatenate(starts), np.concatenate(ends), np.array(owner)
    slanted = p[:, 1] != q[:, 1]
    p, q, owner = p[slanted], q[slanted], owner[slanted]
    if not len(p):
        return []
    up = p[:, 1] < q[:, 1]
    lo, hi = np.where(up[:, None], p, q), np.where(up[:, None], q, p)
    x0, y0, y1 = lo[:, 0], lo[:, 1], hi[:, 1]
    slope = (hi[:, 0] - x0) / (y1 - y0)
    least, most = np.minimum(x0, hi[:, 0]), np.maximum(x0, hi[:, 0])
    heights = [y0, y1]
    for i in range(len(p) - 1):
        j = slice(i + 1, None)
        bent = (slope[j] != slope[i]) & (y0[j] < y1[i]) & (y1[j] > y0[i]) & (least[j] <= most[i]) & (most[j] >= least[i])
        if bent.any():
            k = np.nonzero(bent)[0] + i + 1
            y = (x0[k] - slope[k] * y0[k] - x0[i] + slope[i] * y0[i]) / (slope[i] - slope[k])
            heights.append(y[(y > np.maximum(y0[k], y0[i])) & (y < np.minimum(y1[k], y1[i]))])
    ys = np.unique(np.concatenate(heights))
    layer = [s[0] for s in shapes]
    out = []
    for a, b in zip(ys[:-1], ys[1:]):
        on = np.nonzero((y0 <= a) & (y1 >= b))[0]
        at = x0[on] + slope[on] * ((a + b) / 2 - y0[on])
        on = on[np.argsort(at, kind="stable")]
        below, above = x0[on] + slope[on] * (a - y0[on]), x0[on] + slope[on] * (b - y0[on])
        inside, covers, since = set(), [0, 0], None
        for k, s in enumerate(owner[on].tolist()):
            was = (covers[0] > 0, covers[1] > 0)
            inside ^= {s}
            covers[layer[s]] += 1 if s in inside else -1
            now = (covers[0] > 0, covers[1] > 0)
            if now != was:
                if since is not None and below[k] + above[k] > below[since] + above[since]:
                    out.append((*was, float(a), float(b), float(below[since]), float(below[k]), float(above[since]), float(above[k])))
                since = k if any(now) else None
    return out


def trapezoids(left: DataFrame, right: DataFrame | None = None, by: Sequence[str] = (), tile: float = 1000.0, most: int = 512, depth: int = 16) -> DataFrame:
    """``by, in_left, in_right, y0, y1, left0, right0, left1, right1``: trapezoids that do not overlap within a group.

    ``left`` (``by``, ``rings``) is dissolved within each group and laid over ``right`` (``rings``), of which only what lies in
    tiles of the group is kept, or all of it where there is no ``by``.  Tiles of ``tile`` map units are quartered while over
    ``most`` edges of different pieces cross them, at most ``depth`` times: only where that many edges meet in one point is a
    tile larger.  Null shapes, rings under three points and rings with a missing or non-finite point have no area.
    """
    ship(left.sparkSession)
    g = F.to_json(F.struct(*by)) if by else F.lit("{}")
    shapes = left.select(g.alias("g"), F.lit(0).alias("layer"), F.col("rings").cast(_RINGS))
    if right is not None:
        shapes = shapes.unionByName(right.select(F.lit("{}").alias("g"), F.lit(1).alias("layer"), F.col("rings").cast(_RINGS)))
    # A number given keeps small but costly pieces from being put into a few tasks.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, pieces = None, checkpointed(_dealt(shapes.distinct().repartition(n, "rings"), tile).distinct())
    for _ in range(depth):
        load = pieces.select("layer", *_TILE, "rings", "n").distinct().groupBy(*_TILE).agg(F.sum("n").alias("m"))
        full = checkpointed(load.where(F.col("m") > most).select(*_TILE))
        if full.isEmpty():
            break
        fine = pieces.join(full, _TILE, "left_anti")
        done = fine if done is None else done.unionByName(fine)
        pieces = checkpointed(_quartered(pieces.join(full, _TILE, "left_semi").select(*pieces.columns).repartition(n, "rings"), tile).distinct())
    pieces = pieces if done is None else done.unionByName(pieces)
    if right is not None and by:
        mine = pieces.where("layer = 0")
        theirs = pieces.where("layer = 1").drop("g").join(mine.select("g", *_TILE).distinct(), _TILE)
        pieces = mine.unionByName(theirs.select(*mine.columns))

    def rows(batches):
        held, some = None, []

        def closed():
            # Equal pieces have come together already; a piece that fills its tile leaves nothing to the others of its layer.
            _, level, tx, ty = held
            size = tile / 2**level
            whole = {la: r for la, r in some if len(r) == 1 and len(r[0]) == 4 and np.ptp(r[0][:, 0]) == (tx + 1) * size - tx * size and np.ptp(r[0][:, 1]) == (ty + 1) * size - ty * size and np.isin(r[0][:, 0], (tx * size, (tx + 1) * size)).all()}
            kept = [(la, r) for la, r in some if la not in whole] + list(whole.items())
            return ((held[0], *t) for t in _sweep(kept))

        for pdf in batches:
            for g_, level, tx, ty, layer, rings in pdf[["g", *_TILE, "layer", "rings"]].itertuples(index=False, name=None):
                if held != (g_, level, tx, ty):
                    if some:
                        yield from closed()
                    held, some = (g_, level, tx, ty), []
                some.append((layer, [np.array([(q["x"], q["y"]) for q in r], float) for r in rings]))
        if some:
            yield from closed()

    names = [f.split()[0] for f in _OUT.split(", ")]
    together = pieces.repartition(n, "g", *_TILE).sortWithinPartitions("g", *_TILE, "layer")
    return _named(together.mapInPandas(lambda batches: _batched(rows(batches), names), _OUT), left, by)


AREA = "((right0 - left0) + (right1 - left1)) / 2 * (y1 - y0)"


def overlay_areas(left: DataFrame, right: DataFrame, by: Sequence[str] = (), tile: float = 1000.0, most: int = 512) -> DataFrame:
    """``by, left_area, shared_area, left_only_area``; without ``by`` also ``right_area, union_area``.

    What shapes of one layer share counts once.  ``shared_area / left_area`` is the covered fraction of an area.  Groups
    without any area have no row.
    """
    t = trapezoids(left, right, by, tile, most).withColumn("area", F.expr(AREA))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("area"))), F.lit(0.0))
    a, b = F.col("in_left"), F.col("in_right")
    cols = [total(a).alias("left_area"), total(a & b).alias("shared_area"), total(a & ~b).alias("left_only_area")]
    if not by:
        cols += [total(b).alias("right_area"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("union_area")]
    out = t.groupBy(*by).agg(*cols) if by else t.agg(*cols)
    return out.where("left_area > 0") if by else out


def _as_rings(t: DataFrame, by: Sequence[str]) -> DataFrame:
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("left0", "y0"), at("right0", "y0"), at("right1", "y1"), at("left1", "y1"), at("left0", "y0"))
    return t.select(*by, F.array(ring).alias("rings"))


def clip(shapes: DataFrame, area: DataFrame, keys: Sequence[str] = (), tile: float = 1000.0, most: int = 512) -> DataFrame:
    """``keys, rings``: the parts of each key's shapes that lie in the area, as convex pieces that do not overlap; keys outside have none."""
    return _as_rings(trapezoids(shapes, area, keys, tile, most).where("in_left and in_right"), keys)


def dissolve(shapes: DataFrame, by: Sequence[str] = (), tile: float = 1000.0, most: int = 512) -> DataFrame:
    """``by, rings``: the union of each group's shapes, as convex pieces that do not overlap."""
    return _as_rings(trapezoids(shapes, None, by, tile, most), by)
