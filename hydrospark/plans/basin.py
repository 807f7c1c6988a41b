"""From a terrain to its river: filled terrain, flow, basin, mainstem, heights, bank profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators import banks as B
from hydrospark.operators import graph as G
from hydrospark.operators import hydraulics as H
from hydrospark.operators import raster as R
from hydrospark.operators import series as S
from hydrospark.operators import terrain as T


def prepare(dem: DataFrame, grid: R.Grid, ncols: int, outlet_xy: tuple[float, float], stream_km2: float, mainstem_km2: float, snap_m: float = 250.0, selected_xy: tuple[float, float] | None = None, selected_snap_m: float = 2000.0) -> dict[str, DataFrame]:
    """``terrain`` (row, col, ground, conditioned, fill_depth, area_km2, hand), ``pointers``, ``outlet``, ``mainstem``.

    Flats drain over the filled surface with a hair's rise by distance from their outlets, so every
    cell has a way out; ties go to the first neighbour in row-major order.
    """
    filled = G.checkpointed(T.fill_depressions(dem))
    routed = G.checkpointed(route_filled(filled, grid))
    ptr = G.checkpointed(R.pointers(routed, ncols))
    km2 = R.cell_area(grid) / 1e6
    area = G.accumulate(ptr).withColumn("total", F.col("total") * km2)
    area = G.checkpointed(area)
    cell = lambda df: df.withColumns({"row": F.floor(F.col("id") / ncols).cast("int"), "col": (F.col("id") % ncols).cast("int")})
    streams = cell(area.where(F.col("total") >= stream_km2))
    outlet = G.checkpointed(R.nearest_true_cell(streams, *outlet_xy, grid, snap_m).select(R.cell_id(ncols), "distance_m"))
    basin = G.checkpointed(G.basin(ptr, outlet).select("id"))
    inside = ptr.join(basin, "id", "left_semi")
    top = outlet.join(area, "id").first()
    least = min(mainstem_km2, max(0.1, 0.8 * top["total"])) if top else mainstem_km2
    if selected_xy is None:
        main = G.mainstem(inside, area, outlet, least)
    else:
        start = R.nearest_true_cell(streams.join(basin, "id", "left_semi"), *selected_xy, grid, selected_snap_m).select(R.cell_id(ncols))
        branch = G.selected_branch(inside, area, start, outlet, least)
        path = inside.join(branch, "id", "left_semi").join(outlet.select("id", F.lit(True).alias("o")), "id", "left").select("id", F.when(F.col("o").isNull(), F.col("ptr")).alias("ptr"))
        main = G.follow(path).select("id", F.col("steps").alias("path_index"))
    main = G.checkpointed(cell(main))
    z = filled.select(R.cell_id(ncols), F.col("filled").alias("z"))
    hand = G.height_above_drain(inside, z, area.where(F.col("total") >= stream_km2).join(basin, "id", "left_semi").select("id"))
    terrain = filled.select(R.cell_id(ncols), "row", "col", F.col("value").alias("ground"), F.col("filled").alias("conditioned"), "fill_depth").join(basin, "id", "left_semi").join(area.select("id", F.col("total").alias("area_km2")), "id").join(hand.select("id", "hand"), "id", "left")
    return {"terrain": G.checkpointed(terrain), "pointers": ptr, "outlet": outlet, "mainstem": main}


def route_filled(filled: DataFrame, grid: R.Grid = R.UNIT_GRID) -> DataFrame:
    """Flow directions over a filled surface; on flats water goes towards the nearest cell that drains.

    The distance to such a cell along equal levels is the cost of a way without rise; adding a hair
    of it makes every flat slope to its outlet.
    """
    steep = R.flow_direction(filled.select("row", "col", F.col("filled").alias("value")), grid=grid)
    near = R.neighbours(filled.select("row", "col", F.col("filled").alias("z")), "z")
    edge = F.lit(False)
    for k in range(8):
        edge = edge | F.col(f"n{k}").isNull()
    drains = steep.where("direction >= 0").select("row", "col").unionByName(near.where(edge).select("row", "col")).distinct()
    way = T.cost_distance(filled.select("row", "col", F.col("filled").alias("value")), drains, "value", grid, 8, 1e9)
    hair = filled.join(way.select("row", "col", "cost"), R.CELL).select("row", "col", (F.col("filled") + F.least(F.col("cost"), F.lit(1e6)) * 1e-9).alias("value"))
    return R.flow_direction(hair, grid=grid)


def bank_profile(prepared: dict[str, DataFrame], dem: DataFrame, grid: R.Grid, ncols: int, spacing: float = 150.0, half_width: float = 150.0, sample: float = 1.0, **search) -> DataFrame:
    """Sections along the mainstem with banks, freeboard, slope and conveyance; ``workspace_id`` is 0."""
    path = prepared["mainstem"].join(prepared["terrain"].select("id", "conditioned", "area_km2"), "id")
    centre = X.cell_center("row", "col", grid)
    path = path.select(F.lit(0).alias("workspace_id"), "path_index", centre["x"].alias("x"), centre["y"].alias("y"), "conditioned", "area_km2")
    w = W.partitionBy("workspace_id").orderBy("path_index")
    line = G.checkpointed(path.withColumn("station_m", S.station("x", "y", w)))
    keys = ["workspace_id", "station_m"]
    picked = S.tangents(line, ["workspace_id"]).join(S.pick_sections(line, ["workspace_id"], spacing=spacing), keys, "left_semi")
    nth = F.row_number().over(W.partitionBy("workspace_id").orderBy("station_m")) - 1
    sections = G.checkpointed(picked.select(*keys, nth.alias("section_id"), "path_index", F.col("x").alias("center_x"), F.col("y").alias("center_y"), "cross_dx", "cross_dy", F.col("conditioned").alias("routing_channel_elevation_m_navd88"), F.col("area_km2").alias("upstream_area_km2")))
    samples = G.checkpointed(B.smoothed(B.sample_lines(sections, dem, grid, keys, half_width, sample), keys))
    found = B.bank_sections(sections, B.find_banks(samples, keys, spacing=sample, **search), keys)
    profile = H.channel_slope(H.finalize_freeboard(G.checkpointed(found)))
    limits = samples.join(profile.select(*keys, "left_bank_distance_m", "right_bank_distance_m", "lower_bank_final_ft_navd88"), keys)
    wet = H.wetted_geometry(limits, keys, F.col("lower_bank_final_ft_navd88") * C.FT_TO_M, left=F.col("left_bank_distance_m"), right=F.col("right_bank_distance_m"))
    wet = wet.withColumnsRenamed({"area_m2": "bankfull_area_proxy_m2", "wetted_perimeter_m": "bankfull_wetted_perimeter_proxy_m", "hydraulic_radius_m": "bankfull_hydraulic_radius_proxy_m", "top_width_m": "bankfull_top_width_proxy_m"})
    out = profile.join(wet, keys, "left").withColumn("bankfull_conveyance_index", X.conveyance("bankfull_area_proxy_m2", "bankfull_hydraulic_radius_proxy_m", "local_channel_slope"))
    return G.checkpointed(out)


def check_area(found_km2: float, expected_sqmi: float | None) -> float | None:
    """The ratio of areas; fails unless it lies between a half and one and a half."""
    if not expected_sqmi:
        return None
    ratio = found_km2 / (expected_sqmi * C.SQMI_TO_KM2)
    if not 0.5 <= ratio <= 1.5:
        raise ValueError(f"basin area is {ratio:.2f} times what is expected")
    return ratio


def check_datum(stage_ft: float, channel_ft: float, limit_ft: float = 10.0) -> float:
    """How far the current level lies from the channel; fails beyond the limit."""
    gap = stage_ft - channel_ft
    if abs(gap) > limit_ft:
        raise ValueError(f"the level lies {gap:.1f} ft from the channel: the datum does not fit")
    return gap


def check_hand(terrain: DataFrame) -> None:
    """Heights above drainage must not be below -0.01."""
    bad = terrain.where("hand < -0.01").limit(1).count()
    if bad:
        raise ValueError("a cell lies below the drain that it flows to")
