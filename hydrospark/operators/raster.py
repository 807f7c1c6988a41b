"""Rasters as tables of cells ``(row, col, value)``; masks are the rows that are in.

``grid`` is the affine transform (a, b, c, d, e, f) of the raster: x = c + col a + row b.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators import graph as G
from hydrospark.operators.order import percentiles
from hydrospark.session import ship

Grid = tuple[float, float, float, float, float, float]
UNIT_GRID: Grid = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
#: Neighbours in row-major order.
EIGHT = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
CELL = ["row", "col"]
#: Cells across a tile in which the nearest sections are looked for, at most.
SECTION_TILE = 256


def cell_area(grid: Grid) -> float:
    return abs(grid[0] * grid[4] - grid[1] * grid[3])


def step_length(dr: int, dc: int, grid: Grid) -> float:
    return ((dr * abs(grid[4])) ** 2 + (dc * abs(grid[0])) ** 2) ** 0.5


def cell_id(ncols: int) -> Column:
    return (F.col("row").cast("long") * ncols + F.col("col")).alias("id")


def neighbours(cells: DataFrame, value: str = "value", offsets: Sequence[tuple[int, int]] = EIGHT, by: Sequence[str] = ()) -> DataFrame:
    """Every cell with its neighbours' values in ``n0, n1, ...`` (null: none there).

    Each cell sends its value to where it is a neighbour, and one aggregation gathers: a
    single shuffle with map-side combining instead of a self-join.
    """
    sent = F.array(F.struct(F.lit(-1).alias("k"), F.col("row"), F.col("col")), *[F.struct(F.lit(k).alias("k"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col")) for k, (dr, dc) in enumerate(offsets)])
    rows = cells.select(*by, F.col(value).alias("__v"), F.explode(sent).alias("__s")).select(*by, "__v", "__s.k", "__s.row", "__s.col")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("__v")))
    found = rows.groupBy(*by, "row", "col").agg(F.max(F.col("k") == -1).alias("__own"), at(-1).alias(value), *[at(k).alias(f"n{k}") for k in range(len(offsets))])
    return found.where("__own").drop("__own")


def flow_direction(cells: DataFrame, value: str = "value", grid: Grid = UNIT_GRID, by: Sequence[str] = ()) -> DataFrame:
    """M01 (routing): ``direction`` is the neighbour with the steepest descent, -1 at a pit; ties go to the first in row-major order."""
    near = neighbours(cells, value, EIGHT, by)
    drop = [(F.col(value) - F.col(f"n{k}")) / step_length(dr, dc, grid) for k, (dr, dc) in enumerate(EIGHT)]
    best = F.greatest(*drop)
    direction = F.lit(-1)
    for k in reversed(range(8)):
        direction = F.when(drop[k] == best, k).otherwise(direction)
    d = F.when(best > 0, direction).otherwise(-1).cast("int")
    move = lambda axis: F.element_at(F.array(*[F.lit(o[axis]) for o in EIGHT]), F.col("direction") + 1)
    out = near.select(*by, "row", "col", value, d.alias("direction"))
    return out.withColumns({"ds_row": F.when(F.col("direction") >= 0, F.col("row") + move(0)), "ds_col": F.when(F.col("direction") >= 0, F.col("col") + move(1))})


def pointers(directions: DataFrame, ncols: int) -> DataFrame:
    """Flow directions as ``(id, ptr)``; a pit has no pointer."""
    return directions.select(cell_id(ncols), (F.col("ds_row").cast("long") * ncols + F.col("ds_col")).alias("ptr"))


def _half(connectivity: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, -1), (1, 0), (1, 1)]


def links(cells: DataFrame, ncols: int, connectivity: int = 8) -> DataFrame:
    """Links ``(a, b)`` between neighbouring cells of a mask: half of the neighbours are enough."""
    half = _half(connectivity)
    shifted = cells.select((F.col("row").cast("long") * ncols + F.col("col")).alias("a"), F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in half])).alias("s")).select("a", "s.row", "s.col")
    return shifted.join(cells.select("row", "col"), CELL).select("a", (F.col("row").cast("long") * ncols + F.col("col")).alias("b"))


def labels(cells: DataFrame, ncols: int, connectivity: int = 8, tile: int = SECTION_TILE) -> DataFrame:
    """``(id, root)`` of every cell of a mask; root is the smallest id of its component.

    Tiles are labelled alone, each a group of at most ``tile`` by ``tile`` cells.  The graph that is left for rounds has a node for
    each component of a tile, and links only where rims of tiles meet, so rounds do not move cells.
    """
    ship(cells.sparkSession)
    half = _half(connectivity)
    known = cells.select(*CELL).where("row is not null and col is not null")
    kinds = [StructField(c, known.schema[c].dataType) for c in CELL]

    def run(t: pa.Table) -> pa.Table:
        r, c = (t[n].to_numpy().astype(np.int64) for n in CELL)
        ids, part = r * ncols + c, _labelled(r, c, half)
        own = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(own, part, ids)
        return pa.Table.from_arrays([t["row"], t["col"], pa.array(ids), pa.array(own[part])], names=[*CELL, "id", "own"])

    at = lambda c: F.floor(F.col(c) / tile)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.withColumns({"__tr": at("row"), "__tc": at("col")}).repartition(n, "__tr", "__tc").groupBy("__tr", "__tc")
    local = G.checkpointed(dealt.applyInArrow(lambda t: run(t.select(CELL)), StructType([*kinds, StructField("id", LongType()), StructField("own", LongType())])))
    rim = local.where(" or ".join(f"pmod({c}, {tile}) in (0, {tile - 1})" for c in CELL))
    beyond = rim.select(F.col("own").alias("a"), *[at(c).alias(f"__{c}") for c in CELL], F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in half])).alias("s")).select("a", "__row", "__col", "s.row", "s.col")
    met = beyond.where((at("row") != F.col("__row")) | (at("col") != F.col("__col"))).join(rim.select(*CELL, F.col("own").alias("b")), CELL).select("a", "b").distinct()
    groups = G.components(met)
    return local.join(groups, F.col("own") == F.col("node"), "left").select("id", F.coalesce("root", "own").alias("root"))


def _labelled(row: np.ndarray, col: np.ndarray, half: Sequence[tuple[int, int]]) -> np.ndarray:
    """For each cell the number of its component, below that of cells; cells may come twice."""
    width = int(col.max() - col.min()) + 3
    key, back = np.unique((row - row.min()) * width + col - col.min() + 1, return_inverse=True)
    top = np.arange(len(key))
    a, b = [], []
    for dr, dc in half:
        to = key + dr * width + dc
        near = np.minimum(np.searchsorted(key, to), len(key) - 1)
        ok = np.flatnonzero(key[near] == to)
        a.append(ok)
        b.append(near[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        # Every top with a lower neighbour goes, at least half of those that have one.
        np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))
        while not np.array_equal(top, top[top]):
            top = top[top]
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    return top[back]


def overlay(first: DataFrame, *others: DataFrame, how: str = "inner") -> DataFrame:
    """Co-registered rasters side by side; all joins are on (row, col), so one partitioning serves."""
    for o in others:
        first = first.join(o, CELL, how)
    return first


def masked(cells: DataFrame, keep: Sequence[DataFrame] = (), drop: Sequence[DataFrame] = ()) -> DataFrame:
    """Cells that are in every mask of ``keep`` and in none of ``drop``."""
    for m in keep:
        cells = cells.join(m.select("row", "col"), CELL, "left_semi")
    for m in drop:
        cells = cells.join(m.select("row", "col"), CELL, "left_anti")
    return cells


def mosaic(tiles: DataFrame, order: str, value: str = "value") -> DataFrame:
    """Overlapping tiles as one raster; the first tile that knows a cell gives its value."""
    return tiles.where(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min_by(value, order).alias(value))


def sample(points: DataFrame, cells: DataFrame, x: str, y: str, grid: Grid, value: str = "value", out: str = "sampled") -> DataFrame:
    """The value of the cell that holds each point; null outside and on cells without data."""
    cell = X.cell_of(x, y, grid)
    return points.withColumns({"row": cell["row"], "col": cell["col"]}).join(cells.select("row", "col", F.when(X.number(value) != C.RASTER_NODATA, X.number(value)).alias(out)), CELL, "left").drop("row", "col")


def zonal(cells: DataFrame, zone: Sequence[str], value: str = "value", grid: Grid = UNIT_GRID, least: float | None = None) -> DataFrame:
    """Count, area, volume, largest, mean and percentiles of each zone, of whatever size."""
    area = cell_area(grid)
    rows = cells if least is None else cells.where(F.col(value) >= least)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = rows.groupBy(*zone).agg(
        F.count("*").alias("pixels"), (F.count("*") * area).alias("area_m2"), (F.count("*") * area / C.M2_PER_SQMI).alias("area_sqmi"), zero(F.sum(F.col(value) * area)).alias("volume_m3"),
        zero(F.max(value)).alias("max_value"), zero(F.avg(value)).alias("mean_value"),
    )
    ranks = percentiles(rows, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, zone).withColumnsRenamed({z: f"__{z}" for z in zone})
    same = F.lit(True)
    for z in zone:
        same = same & whole[z].eqNullSafe(ranks[f"__{z}"])
    return (whole.join(ranks, same, "left") if zone else whole.crossJoin(F.broadcast(ranks))).drop(*[f"__{z}" for z in zone])


def argmax_cell(cells: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """The first cell, in row-major order, with the largest value."""
    return cells.groupBy(*by).agg(F.max_by(F.struct("row", "col", value), F.struct(value, -F.col("row"), -F.col("col"))).alias("__c")).select(*by, "__c.*")


def confusion(cells: DataFrame, model: Column, reference: Column) -> DataFrame:
    """``code`` of every cell: 0 neither, 1 both, 2 only the model, 3 only the reference."""
    m, r = F.coalesce(model, F.lit(False)), F.coalesce(reference, F.lit(False))
    return cells.withColumn("code", F.when(m & r, 1).when(m, 2).when(r, 3).otherwise(0))


def extent_scores(coded: DataFrame, grid: Grid = UNIT_GRID, by: Sequence[str] = ()) -> DataFrame:
    """Counts and skill of a confusion raster."""
    n = lambda c: F.count(F.when(F.col("code") == c, 1))
    df = coded.groupBy(*by).agg(n(1).alias("tp"), n(2).alias("fp"), n(3).alias("fn"), n(0).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    area = cell_area(grid)
    df = df.withColumns({"precision": tp / (tp + fp + C.EPS), "recall": tp / (tp + fn + C.EPS)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({
        "f1": 2 * p * r / (p + r + C.EPS), "csi": tp / (tp + fp + fn + C.EPS), "specificity": tn / (tn + fp + C.EPS),
        "model_area_m2": (tp + fp) * area, "reference_area_m2": (tp + fn) * area, "area_bias_ratio": F.when(tp + fn > 0, (tp + fp) / (tp + fn)),
    })


def depth_colours(cells: DataFrame, value: str = "value") -> DataFrame:
    """Red, green, blue, alpha of every cell; scaled by the 98th percentile of what is over 2 cm, 0.25 at least."""
    wet = F.col(value) > 0.02
    top = percentiles(cells.where(wet), value, {"__p": 0.98}).agg(F.greatest(F.max("__p"), F.lit(0.25)).alias("__top"))
    out = cells.join(F.broadcast(top))
    c = X.ramp_colour(X.clip(F.col(value) / F.col("__top"), 0.0, 1.0))
    return out.select("row", "col", value, c["red"].alias("red"), c["green"].alias("green"), c["blue"].alias("blue"), F.when(wet, 185).otherwise(0).alias("alpha"))


def coarsen(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Means of blocks of ``factor`` by ``factor`` cells."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias(value))


def resample(target: DataFrame, source: DataFrame, target_grid: Grid, source_grid: Grid, value: str = "value", method: str = "nearest", to_source: Callable[[Column, Column], Sequence[Column]] | None = None) -> DataFrame:
    """The source's values at the target's cell centres (``row, col``); null where it has none.

    ``to_source`` takes (x, y) of the target's system to (x, y) of the source's, where they are not one.  ``bilinear`` weighs the four cells around a centre; cells without data drop out of the weights.
    """
    centre = X.cell_center("row", "col", target_grid)
    rows = target.withColumn("__p", centre)
    if to_source:
        x, y = to_source(F.col("__p")["x"], F.col("__p")["y"])
        rows = rows.withColumn("__p", F.struct(x.alias("x"), y.alias("y")))
    if method == "nearest":
        cell = X.cell_of(F.col("__p")["x"], F.col("__p")["y"], source_grid)
        # No cell has the number of none; where a place can't be null, no filter has ``to_source`` worked once more and by itself.
        known = lambda c: F.coalesce(cell[c], F.lit(-(1 << 31)))
        pairs = rows.select("row", "col", known("row").alias("__r"), known("col").alias("__c"))
        return pairs.join(source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value), ["__r", "__c"], "left").select("row", "col", value)
    a, b, c, d, e, f = source_grid
    det = a * e - b * d
    dx, dy = F.col("__p")["x"] - c, F.col("__p")["y"] - f
    u, v = (e * dx - b * dy) / det - 0.5, (a * dy - d * dx) / det - 0.5
    rows = rows.withColumns({"__u": u, "__v": v})
    fu, fv = F.col("__u") - F.floor("__u"), F.col("__v") - F.floor("__v")
    corner = lambda i, j: F.struct((F.floor("__v") + i).cast("int").alias("__r"), (F.floor("__u") + j).cast("int").alias("__c"), ((fv if i else 1 - fv) * (fu if j else 1 - fu)).alias("__w"))
    four = rows.select("row", "col", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k")).select("row", "col", "k.*").where("__w > 0")
    got = four.join(source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value), ["__r", "__c"], "left")
    known = F.when(F.col(value).isNotNull(), F.col("__w"))
    return got.groupBy("row", "col").agg(X.safe_divide(F.sum(F.col("__w") * F.col(value)), F.sum(known)).alias(value))


def reproject(source: DataFrame, source_grid: Grid, target_grid: Grid, to_target: Callable[[Column, Column], Sequence[Column]], to_source: Callable[[Column, Column], Sequence[Column]], value: str = "value", method: str = "nearest", tile: int = 64) -> DataFrame:
    """A raster in another reference system: ``row, col, value`` of the target cells whose centre has a value.

    The source's tiles are sent through ``to_target`` by points around their borders; the target tiles that these
    footprints touch, and no others, are laid out as cells, and each cell's centre is taken back by ``to_source``.
    """
    tiles = source.select(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).distinct()
    along = [k / 8 for k in range(9)]
    border = sorted({(a, b) for a in along for b in (0.0, 1.0)} | {(b, a) for a in along for b in (0.0, 1.0)})
    a, b, c, d, e, f = map(float, source_grid)

    # The points are rows, so that what ``to_target`` says is in the plan once and not for each of them.
    # A cell more on each side, as bilinear weights reach that far.
    at = tiles.select("tr", "tc", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r, k in border])).alias("b"))
    at = at.select("tr", "tc", (F.col("tr") * tile - 1 + F.col("b.r") * (tile + 2)).alias("row"), (F.col("tc") * tile - 1 + F.col("b.k") * (tile + 2)).alias("col"))
    at = at.select("tr", "tc", (c + F.col("col") * a + F.col("row") * b).alias("x"), (f + F.col("col") * d + F.col("row") * e).alias("y"))
    x, y = to_target(F.col("x"), F.col("y"))
    at = at.select("tr", "tc", x.alias("x"), y.alias("y"))
    points = at.select("tr", "tc", X.cell_of(F.col("x"), F.col("y"), target_grid).alias("p"))
    boxes = points.groupBy("tr", "tc").agg(F.min("p.row").alias("r0"), F.max("p.row").alias("r1"), F.min("p.col").alias("c0"), F.max("p.col").alias("c1"))
    # Between the points of a border it may bend out by a little more.
    spare = lambda lo, hi: 1 + F.ceil((F.col(hi) - F.col(lo)) / 50)
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - spare(lo, hi)) / tile), F.floor((F.col(hi) + spare(lo, hi)) / tile))
    touched = boxes.select(F.explode(span("r0", "r1")).alias("tr"), span("c0", "c1").alias("tcs")).select("tr", F.explode("tcs").alias("tc")).distinct()
    rows = touched.select("tr", "tc", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("i")).select((F.col("tr") * tile + F.col("i")).cast("int").alias("row"), "tc")
    # Few rows until here, but as many cells as the target has from here on: they are dealt to tasks and not broadcast.
    rows = rows.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "tc")
    laid = rows.select("row", "tc", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("j"))
    target = laid.select("row", (F.col("tc") * tile + F.col("j")).cast("int").alias("col"))
    return resample(target, source.hint("merge"), target_grid, source_grid, value, method, to_source).where(F.col(value).isNotNull())


def adaptive_resolution(boxes: DataFrame, width: str, height: str, base: float, max_cells: int = 12_000_000, steps: Sequence[float] = (2, 3, 4, 5, 6, 8, 10, 12, 15, 20)) -> DataFrame:
    """For each box the finest of the steps, from ``base`` on, that keeps it within ``max_cells``; the coarsest if none does.

    Adds ``chosen_resolution_m, estimated_bbox_cells, adaptive``; sides count as one metre at least.
    """
    sizes = F.array(*[F.lit(s) for s in sorted({float(base), *map(float, steps)}) if s >= base])
    area = F.greatest(X.number(width), F.lit(1.0)) * F.greatest(X.number(height), F.lit(1.0))
    fits = F.filter(sizes, lambda s: area / (s * s) <= max_cells)
    out = boxes.withColumn("chosen_resolution_m", F.coalesce(F.get(fits, F.lit(0)), F.element_at(sizes, -1)))
    return out.withColumns({"estimated_bbox_cells": F.floor(area / (F.col("chosen_resolution_m") * F.col("chosen_resolution_m"))), "adaptive": F.col("chosen_resolution_m") > base})


def nearest_section(cells: DataFrame, sections: DataFrame, grid: Grid, reach: float, carried: Sequence[str] = ("wse",), order: str = "section_id") -> DataFrame:
    """Every cell with the nearest section cell within ``reach`` and what that section carries.

    ``sections`` has ``x, y``, ``order`` and the carried columns.  Of two sections in one cell the
    later wins; of equal distances the lower (row, col).  Sections go to the tiles that they can matter to.  There
    each line of sections (a column of the grid, or a row where those are fewer) gives the nearest of its own to a line of
    cells across it by one search, so a cell meets the lines in reach and not all sections on them.
    """
    ship(cells.sparkSession)
    cell = X.cell_of("x", "y", grid)
    s = sections.select(cell["row"].alias("__sr"), cell["col"].alias("__sc"), F.struct(order, *carried).alias("__p")).where("__sr is not null and __sc is not null")
    s = s.groupBy("__sr", "__sc").agg(F.max_by("__p", f"__p.{order}").alias("__p"))
    sy, sx = abs(grid[4]), abs(grid[0])
    far = int(reach / sy) + 1, int(reach / sx) + 1
    th, tw = (min(max(k, 64), SECTION_TILE) for k in far)
    tile = lambda c, t: F.floor(F.col(c) / t)
    span = lambda c, k, t: F.sequence(F.floor((F.col(c) - k) / t), F.floor((F.col(c) + k) / t))
    s = s.select("*", F.explode(span("__sr", far[0], th)).alias("__tr")).select("*", F.explode(span("__sc", far[1], tw)).alias("__tc"))
    s = s.select("__tr", "__tc", "__sr", "__sc", *[F.col(f"__p.{c}").alias(c) for c in (order, *carried)])
    own = [c for c in cells.columns if c not in CELL]
    asked = cells.select(*CELL, *own, tile("row", th).alias("__tr"), tile("col", tw).alias("__tc"))
    schema = StructType([StructField(n, cells.schema[n].dataType) for n in (*CELL, *own)] + [StructField(n, s.schema[n].dataType) for n in (order, *carried)] + [StructField("distance_m", DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        best, at = np.full(n, np.inf), np.full(n, -1)
        if n and right.num_rows and left["row"].null_count + left["col"].null_count == 0:
            at, best = _nearest_of(*(t[c].to_numpy().astype(np.int64) for t, c in ((left, "row"), (left, "col"), (right, "__sr"), (right, "__sc"))), sy, sx)
        ok = best <= reach * reach
        took = pa.array(np.where(ok, at, 0), pa.int64(), mask=~ok)
        cols = [left[c] for c in (*CELL, *own)] + [right[c].take(took) if right.num_rows else pa.nulls(n, right.schema.field(c).type) for c in (order, *carried)]
        return pa.Table.from_arrays([*cols, pa.array(np.sqrt(np.where(ok, best, 0.0)), mask=~ok)], names=schema.names)

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [df.repartition(n, "__tr", "__tc").groupBy("__tr", "__tc") for df in (asked, s)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, schema)


def _nearest_of(row: np.ndarray, col: np.ndarray, sr: np.ndarray, sc: np.ndarray, sy: float, sx: float) -> tuple[np.ndarray, np.ndarray]:
    """``(at, d2)``: for cells the nearest of the places ``sr, sc`` and the squared distance to it; of equals the lower (row, column)."""
    by_col = len(np.unique(sc)) <= len(np.unique(sr))
    # Lines run along one axis; a place is on the line ``across`` at ``along``.
    (along, across, s_along, s_across), (step, side) = ((row, col, sr, sc), (sy, sx)) if by_col else ((col, row, sc, sr), (sx, sy))
    order = np.lexsort((s_along, s_across))
    lines, first = np.unique(s_across[order], return_index=True)
    places, back = np.unique(along, return_inverse=True)
    at, best = np.full(len(row), -1), np.full(len(row), np.inf)
    for line, a, b in zip(lines.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        on = s_along[order[a:b]]
        right = np.searchsorted(on, places)
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, len(on) - 1)
        # Of two at the same distance the lower one.
        pick = np.where(np.abs(places - on[left]) <= np.abs(places - on[right]), left, right)[back]
        d2 = ((along - on[pick]) * step) ** 2 + ((across - line) * side) ** 2
        new = order[a:b][pick]
        better = d2 < best
        same = np.flatnonzero((d2 == best) & (at >= 0))
        old = at[same]
        better[same] = (sr[new[same]] < sr[old]) | ((sr[new[same]] == sr[old]) & (sc[new[same]] < sc[old]))
        at, best = np.where(better, new, at), np.where(better, d2, best)
    return at, best


def nearest_true_cell(mask: DataFrame, x: float, y: float, grid: Grid, reach: float = 250.0) -> DataFrame:
    """The cell of the mask nearest to a point, looked for in the square of ``reach`` around it; may be empty."""
    size = max(abs(grid[0]), abs(grid[4]))
    k = max(1, int(-(-reach // size)))
    a, b, c, d, e, f = grid
    det = a * e - b * d
    r0, c0 = int((a * (y - f) - d * (x - c)) // det), int((e * (x - c) - b * (y - f)) // det)
    centre = X.cell_center("row", "col", grid)
    near = mask.where(F.col("row").between(r0 - k, r0 + k) & F.col("col").between(c0 - k, c0 + k)).withColumn("distance_m", F.hypot(centre["x"] - x, centre["y"] - y))
    return near.orderBy("distance_m", "row", "col").limit(1).select("row", "col", "distance_m")


def inside_rings(cells: DataFrame, rings: DataFrame, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """``row, col`` of the cells whose centre is inside each polygon (column ``rings``), with its ``keys``.

    Each polygon is sent to the tiles that its box touches, of a size (8 cells, 64, 512, ...) at which those are few;
    cells meet only the polygons of their own tiles.
    """
    corner = lambda f, axis: f(F.transform(F.flatten("rings"), lambda p: p[axis]))
    boxes = rings.select(*keys, "rings", corner(F.array_min, "x").alias("x0"), corner(F.array_max, "x").alias("x1"), corner(F.array_min, "y").alias("y0"), corner(F.array_max, "y").alias("y1"))
    lo, hi = X.cell_of("x0", "y0", grid), X.cell_of("x1", "y1", grid)
    across = F.greatest(F.abs(hi["row"] - lo["row"]), F.abs(hi["col"] - lo["col"]))
    boxes = boxes.withColumn("__t", F.aggregate(F.array(*[F.lit(8**k) for k in range(2, 11)]), F.lit(8).cast("long"), lambda t, more: F.when(across > 4 * t, more.cast("long")).otherwise(t)))
    sizes = sorted(r[0] for r in boxes.select("__t").distinct().collect())  # ten at most
    span = lambda axis: F.sequence(F.floor(F.least(lo[axis], hi[axis]) / F.col("__t")), F.floor(F.greatest(lo[axis], hi[axis]) / F.col("__t")))
    tiles = boxes.select(*keys, "rings", "__t", F.explode(span("row")).alias("__tr"), span("col").alias("s")).select(*keys, "rings", "__t", "__tr", F.explode("s").alias("__tc"))
    centre = X.cell_center("row", "col", grid)
    placed = cells.select("row", "col", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("__t") if sizes else F.lit(0).cast("long").alias("__t"))
    met = placed.withColumns({"__tr": F.floor(F.col("row") / F.col("__t")), "__tc": F.floor(F.col("col") / F.col("__t"))}).join(tiles, ["__t", "__tr", "__tc"])
    return met.where(X.point_in_rings(centre["x"], centre["y"], "rings")).select(*keys, "row", "col").distinct()


def clip_to_rings(cells: DataFrame, rings: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre is inside one of the polygons (column ``rings``)."""
    return cells.join(inside_rings(cells, rings, grid), CELL, "left_semi")


def check_crs(tiles: DataFrame, crs: str = "crs") -> str:
    """The one reference system of all tiles; fails where they have several, or none."""
    found = [r[0] for r in tiles.select(crs).distinct().limit(3).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"tiles must have one reference system, not {found}")
    return found[0]


def extent_edges(mask: DataFrame) -> DataFrame:
    """The sides of a mask's cells that are on its border: those that only one cell has.

    ``(r0, c0, r1, c1)`` are corners of the grid, with the mask on the left of the way.
    """
    r, c = F.col("row"), F.col("col")
    side = lambda *p: F.struct(*[v.cast("int").alias(n) for v, n in zip(p, ("r0", "c0", "r1", "c1"))])
    ways = F.array(side(r, c, r + 1, c), side(r + 1, c, r + 1, c + 1), side(r + 1, c + 1, r, c + 1), side(r, c + 1, r, c))
    each = mask.select(F.explode(ways).alias("e")).select("e.*")
    end = lambda n: F.struct(F.col(f"r{n}").alias("r"), F.col(f"c{n}").alias("c"))
    one = each.withColumn("__k", F.array_sort(F.array(end(0), end(1)))).groupBy("__k").agg(F.count("*").alias("n"), F.min(F.struct("r0", "c0", "r1", "c1")).alias("e")).where("n = 1")
    return one.select("e.*")


def running_fill(cells: DataFrame, budget_m3: float, cost: str, depth: str, grid: Grid = UNIT_GRID, parts: int | None = None) -> DataFrame:
    """W14, M17 (second half): cells are filled in the order of cost, row and column until the budget is used.

    The last cell takes what is left.  Two passes: cells are ranged by cost into partitions (cells
    of one cost that has several quantiles, such as flat ground, by their rows), the partitions'
    sums come to the driver (a number for each), and each partition then sums on from what lies
    before it; no single task holds all cells.
    """
    area = cell_area(grid)
    budget = max(float(budget_m3), 0.0)
    n = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = cells.where((F.col(depth) > 0) & F.col(cost).isNotNull())
    cuts, rows = ok.approxQuantile([cost, "row"], [i / n for i in range(1, n)], 0.001) if n > 1 else ([], [])
    frequent = sorted({x for x in cuts if cuts.count(x) > 1})
    ship(cells.sparkSession)

    def below(c: str, at: list[float]) -> Column:
        """How many of the cuts are below; by a search, as there are as many cuts as tasks."""
        found = np.unique(np.array(at, float))
        return F.when(F.col(c).isNotNull(), F.pandas_udf(lambda v: pd.Series(np.searchsorted(found, v.to_numpy(float))), "long")(F.col(c)))

    part = below(cost, cuts)
    band = F.when(F.col(cost).isin(frequent), 1 + below("row", rows)).otherwise(0) if frequent else F.lit(0)
    ranged = ok.withColumns({"__p": part * (n + 1) + band, "__v": F.col(depth) * area})
    sums = {r["__p"]: r["s"] for r in ranged.groupBy("__p").agg(F.sum("__v").alias("s")).collect()}
    before, total = {}, 0.0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]
    offset = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p).cast("long"), F.lit(b))]), F.col("__p")) if before else F.lit(0.0)
    w = W.partitionBy("__p").orderBy(cost, "row", "col").rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumn("__cum", F.sum("__v").over(w) + offset)
    prev = F.col("__cum") - F.col("__v")
    filled = F.when(F.col("__cum") <= budget + 1e-12, F.col(depth)).when(prev < budget, (F.lit(budget) - prev) / area)
    return run.withColumn("filled_depth", filled).where("filled_depth is not null").drop("__p", "__v", "__cum")
