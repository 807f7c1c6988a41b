"""Areas of interest: their context and what a scenario does inside them (M29, M30), and the regional catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import geometry as G
from hydrospark.operators import matching as M
from hydrospark.operators import raster as R
from hydrospark.operators.graph import checkpointed


def context(areas: DataFrame, keys: Sequence[str], domain: tuple[float, float, float, float], gauge: tuple[float, float], grid: R.Grid, basin: DataFrame, mainstem: DataFrame) -> DataFrame:
    """For every area (``rings``) how far the model covers it, with ``status`` and ``warnings``.

    ``domain`` is the box of the terrain (x0, y0, x1, y1); ``basin`` and ``mainstem`` are masks of cells, and the
    basin's share of an area is that of the cells whose centres lie inside it.  Areas of equal rings are worked once.
    """
    shapes = checkpointed(areas.select("rings").distinct().withColumn("__shape", F.monotonically_increasing_id()))
    known = checkpointed(_context(shapes, ["__shape"], domain, gauge, grid, basin, mainstem).join(shapes.withColumnRenamed("rings", "__rings"), "__shape"))
    return areas.select(*keys, "rings").join(known, F.col("rings").eqNullSafe(F.col("__rings"))).drop("rings", "__rings", "__shape")


def _context(areas: DataFrame, keys: Sequence[str], domain: tuple[float, float, float, float], gauge: tuple[float, float], grid: R.Grid, basin: DataFrame, mainstem: DataFrame) -> DataFrame:
    """``context`` of areas that all differ."""
    x0, y0, x1, y1 = domain
    gx, gy = (F.lit(float(v)) for v in gauge)
    inside = F.lit(x0 <= gauge[0] <= x1 and y0 <= gauge[1] <= y1)
    size = areas.select(*keys, "rings", G.ring_area().alias("area_m2"))
    covered = G.clip_convex(size.select(*keys, "rings"), [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], keys).select(*keys, G.ring_area().alias("__covered"))
    within = R.inside_rings(basin, areas.select(*keys, "rings"), grid, keys).groupBy(*keys).agg((F.count("*") * R.cell_area(grid)).alias("__basin"))
    touched = R.inside_rings(mainstem, areas.select(*keys, "rings"), grid, keys).select(*keys, F.lit(True).alias("__main")).distinct()
    df = size.join(covered, list(keys), "left").join(within, list(keys), "left").join(touched, list(keys), "left")
    share = lambda c: F.coalesce(X.safe_divide(F.coalesce(c, F.lit(0.0)), F.col("area_m2")), F.lit(0.0))
    df = df.withColumns({
        "gauge_inside_aoi": X.point_in_rings(gx, gy, "rings"), "gauge_distance_to_aoi_m": X.distance_to_rings(gx, gy, "rings"), "gauge_inside_dem": inside,
        "aoi_dem_coverage_fraction": share(F.col("__covered")), "aoi_overlap_with_basin_fraction": share(F.col("__basin")), "aoi_intersects_mainstem": F.coalesce("__main", F.lit(False)),
    })
    warnings = X.aoi_warnings("gauge_inside_dem", "aoi_dem_coverage_fraction", "aoi_overlap_with_basin_fraction", "aoi_intersects_mainstem", "gauge_distance_to_aoi_m")
    return df.withColumns({"warnings": warnings, "status": X.aoi_status("gauge_inside_dem", "aoi_dem_coverage_fraction", "aoi_overlap_with_basin_fraction")}).drop("rings", "__covered", "__basin", "__main")


def inside_area(depth: DataFrame, area: DataFrame, grid: R.Grid, potential: DataFrame | None = None, min_depth_m: float = 0.05) -> dict[str, DataFrame]:
    """A scenario cut to an area: ``depth`` (and ``potential``) cells, the outlines of the flooded ones, and ``summary``.

    Depth rasters have ``row, col, value``; the summary counts cells from ``min_depth_m`` on.
    """
    cut = R.clip_to_rings(depth, area, grid)
    out = {"depth": cut, "extent": G.outlines(cut.where(F.col("value") >= min_depth_m).select("row", "col"), grid), "summary": R.zonal(cut, [], "value", grid, min_depth_m)}
    if potential is not None:
        out["potential"] = R.clip_to_rings(potential, area, grid)
    return out


def regional_catalog(boundary: DataFrame, channels: DataFrame, streams: DataFrame, tile: float = 0.5) -> DataFrame:
    """``id, display_name, source, line`` of the region's waters.

    Channels (``id, name, fname, kind, line``) count if they are major and have a name.  Streams (``id, name, stream_order,
    ftype, line``) count if they have a name, are of the third order or higher and of a natural kind, and meet a
    county of the boundary (``rings``); boxes are matched first, then shapes.
    """
    main = channels.where("kind = 'Major' and name is not null").select("id", F.coalesce("name", "fname").alias("display_name"), F.lit("channel").alias("source"), "line")
    large = streams.where(F.col("name").isNotNull() & (F.col("stream_order") >= 3) & F.col("ftype").isin(460, 558, 336, 468))
    edge = lambda f, points, axis: f(F.transform(points, lambda p: p[axis]))
    boxes = large.select("*", edge(F.array_min, F.col("line"), "x").alias("x0"), edge(F.array_min, F.col("line"), "y").alias("y0"), edge(F.array_max, F.col("line"), "x").alias("x1"), edge(F.array_max, F.col("line"), "y").alias("y1"))
    flat = F.flatten("rings")
    counties = boundary.select("rings", edge(F.array_min, flat, "x").alias("tx0"), edge(F.array_min, flat, "y").alias("ty0"), edge(F.array_max, flat, "x").alias("tx1"), edge(F.array_max, flat, "y").alias("ty1"))
    met = M.range_tiles(boxes, counties, tile).where(X.line_meets_rings("line", "rings")).select("id").distinct()
    return main.unionByName(large.join(met, "id", "left_semi").select("id", F.col("name").alias("display_name"), F.lit("stream").alias("source"), "line"))


def by_id(candidates: DataFrame, site_no: str, order: str = "score") -> DataFrame:
    """The candidate of that number, the first of several."""
    return candidates.where(F.col("site_no") == site_no).orderBy(order).limit(1)
