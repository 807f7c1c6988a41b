"""The inundation screen and what it is made of, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators import banks as B
from hydrospark.operators import geometry as G
from hydrospark.operators import graph as Gr
from hydrospark.operators import hydraulics as H
from hydrospark.operators import raster as R
from hydrospark.operators import series as S
from hydrospark.operators import terrain as T


@dataclass(frozen=True)
class Screen:
    """Settings of the screen; the defaults are those of the pilot."""

    grid: R.Grid
    nrows: int
    ncols: int
    gauge_flow_cfs: float
    gauge_stage_ft: float
    bankfull_flow_cfs: float
    gauge_bank_ft: float
    gauge_channel_ft: float
    gauge_area_km2: float
    connectivity: int = 4
    min_depth_m: float = 0.05
    max_hand_m: float = 6.0
    section_reach_m: float = 1200.0
    exclusion_buffer_m: float = 2.0
    min_component_pixels: int = 20
    overtop_from_ft: float = 0.02
    volume_fraction: float = 1.0
    duration_hours: float = 6.0
    max_gap_hours: float = 3.0
    uphill_penalty: float = 8.0
    capacity_exponent: float = 0.70
    deep_depth_m: float = 3.0
    fill_depth_warning_m: float = 0.5
    volume_warning_ratio: float = 2.0


def levels(profile: DataFrame, s: Screen, controls: DataFrame | None = None, by=("workspace_id",)) -> DataFrame:
    """Water levels of all sections."""
    out = H.section_levels(H.robust_capacity(profile, s.bankfull_flow_cfs, s.gauge_area_km2, by, s.capacity_exponent), s.gauge_flow_cfs, s.gauge_stage_ft, s.bankfull_flow_cfs, s.gauge_bank_ft, s.gauge_channel_ft, s.gauge_area_km2, by)
    out = H.stage_controls(out, controls, by) if controls is not None else out
    return out.withColumn("overtopped", F.col("local_overtop_ft") >= s.overtop_from_ft)


def budget_m3(s: Screen, hydrograph: DataFrame | None = None) -> tuple[float, float, str]:
    """H02 or H21: (excess volume, what the floodplain takes of it, source)."""
    if hydrograph is None:
        excess = max(s.gauge_flow_cfs - s.bankfull_flow_cfs, 0.0) * C.CFS_TO_CMS * 3600.0 * max(s.duration_hours, 0.0)
        source = "constant_excess_flow_x_duration"
    else:
        h = S.normalize_hydrograph(hydrograph, ())
        row = S.excess_volume(h, s.bankfull_flow_cfs, (), s.max_gap_hours).first()
        excess, source = float(row["excess_volume_m3"] or 0.0), "integrated_hydrograph"
    return excess, excess * min(max(s.volume_fraction, 0.0), 1.0), source


def screen(terrain: DataFrame, mainstem: DataFrame, profile: DataFrame, s: Screen, hydrograph: DataFrame | None = None, controls: DataFrame | None = None) -> dict[str, DataFrame | float | str]:
    """Depths of a flood from a river profile over a terrain, bounded by its volume.

    ``terrain`` has ``row, col, ground, hand`` (and ``fill_depth``); ``mainstem`` is a mask; ``profile`` has the columns
    of a finished bank profile.  The result holds the tables ``levels, corridor, candidates, seeds, potential, depth`` and the
    budget.  Depths under ``min_depth_m`` are dropped after the fill, so the stored volume may be less than what was filled.
    """
    section = Gr.checkpointed(levels(profile, s, controls))
    corridor = Gr.checkpointed(G.cells_near_rings(G.corridor_quads(profile), s.grid, s.nrows, s.ncols, s.exclusion_buffer_m))
    places = section.select(F.col("center_x").alias("x"), F.col("center_y").alias("y"), "section_id", F.col("scenario_wse_m_navd88").alias("wse")).where("wse is not null")
    near = R.nearest_section(terrain, places, s.grid, s.section_reach_m)
    depth = F.col("wse") - F.col("ground")
    base = near.withColumn("depth", depth).where(F.col("hand").between(-1e-6, s.max_hand_m) & (F.col("depth") >= s.min_depth_m))
    base = Gr.checkpointed(R.masked(base, drop=[corridor, mainstem]))
    dry = Gr.checkpointed(R.masked(terrain, drop=[corridor, mainstem]))
    seeds = Gr.checkpointed(B.seeds(section, dry, s.grid, ["section_id"], least_depth=s.min_depth_m, passable=F.col("hand").between(-1e-6, s.max_hand_m)))
    # Seeds outside the candidates open the candidates next to them.
    around = seeds.select("row", "col").unionByName(seeds.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in (R.FOUR if s.connectivity == 4 else R.EIGHT)])).alias("n")).select("n.row", "n.col")).distinct()
    kept = Gr.seeded(Gr.checkpointed(R.labels(base, s.ncols, s.connectivity)), around.select(R.cell_id(s.ncols)), s.min_component_pixels)
    potential = Gr.checkpointed(base.withColumn("id", F.col("row").cast("long") * s.ncols + F.col("col")).join(kept.select("id"), "id", "left_semi").drop("id"))
    excess, budget, source = budget_m3(s, hydrograph)
    filled = T.volume_limited_fill(potential, seeds, budget, "depth", "ground", s.grid, s.connectivity, s.uphill_penalty)
    out = Gr.checkpointed(filled.select("row", "col", F.col("filled_depth").alias("depth")).where(F.col("depth") >= s.min_depth_m))
    return {"levels": section, "corridor": corridor, "candidates": base, "seeds": seeds, "potential": potential, "depth": out, "excess_volume_m3": excess, "budget_m3": budget, "volume_source": source}


def summary(result: dict, terrain: DataFrame, s: Screen) -> DataFrame:
    """One row about a screen: areas, volumes, the deepest cell and warnings."""
    area = R.cell_area(s.grid)
    stats = lambda df, p: df.agg(F.count("*").alias(f"{p}_pixels"), (F.count("*") * area).alias(f"{p}_area_m2"), (F.coalesce(F.sum("depth"), F.lit(0.0)) * area).alias(f"{p}_volume_m3"), F.coalesce(F.max("depth"), F.lit(0.0)).alias(f"{p}_max_depth_m"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias(f"{p}_mean_depth_m"))
    deepest = R.argmax_cell(result["depth"], "depth").select(F.col("row").alias("max_row"), F.col("col").alias("max_col"))
    spot = deepest.join(terrain.withColumnsRenamed({"row": "max_row", "col": "max_col"}), ["max_row", "max_col"], "left")
    out = stats(result["depth"], "flood").join(F.broadcast(stats(result["potential"], "potential"))).join(F.broadcast(spot), how="left", on=F.lit(True))
    excess, budget = F.lit(float(result["excess_volume_m3"])), F.lit(float(result["budget_m3"]))
    flags = F.array_compact(F.array(
        F.when((excess > 0) & (F.col("potential_volume_m3") / F.greatest(excess, F.lit(1e-12)) > s.volume_warning_ratio), "potential_connected_storage_exceeds_excess_flow_volume_proxy"),
        F.when((budget > 0) & (F.col("flood_volume_m3") > budget * 1.001), "volume_limited_storage_exceeds_budget_unexpected"),
        F.when(F.col("fill_depth") >= s.fill_depth_warning_m, "maximum_depth_location_has_large_dem_fill_depth") if "fill_depth" in terrain.columns else F.lit(None).cast("string"),
        F.when(F.col("flood_max_depth_m") >= s.deep_depth_m, "maximum_depth_exceeds_deep_depth_qa_threshold"),
    ))
    return out.withColumns({"excess_volume_m3": excess, "budget_m3": budget, "volume_source": F.lit(result["volume_source"]), "qa_flags": F.array_join(F.array_sort(F.array_distinct(flags)), ";")})
