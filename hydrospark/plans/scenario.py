"""Rainfall what-ifs and live runs on top of the screen."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators import hydraulics as H
from hydrospark.operators import series as S
from hydrospark.plans import inundation as I


def rainfall_hydrograph(spark: SparkSession, profile: DataFrame, rainfall_in: float, duration_hours: float, basin_sqmi: float, wetness: str = "normal", curve_number: float | None = None, baseline_cfs: float = 0.0, timestep_minutes: float = 15.0, start: str = "2000-01-01 00:00:00") -> DataFrame:
    """The hydrograph of a storm over a basin; times start at ``start``."""
    if rainfall_in <= 0 or duration_hours <= 0:
        raise ValueError("rain and duration must be positive")
    cn = float(curve_number) if curve_number is not None else C.CURVE_NUMBERS.get(wetness.strip().lower(), C.CURVE_NUMBERS["normal"])
    shape = H.profile_geometry(profile).first()
    row = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in (("rainfall_in", rainfall_in), ("duration_hours", duration_hours), ("basin_area_sqmi", basin_sqmi), ("curve_number", min(max(cn, 30.0), 98.0)), ("mainstem_length_m", shape["length_m"]), ("mainstem_slope", shape["slope"]), ("baseline_cfs", baseline_cfs))])
    out = H.scs_hydrograph(row, timestep_minutes)
    return out.withColumn("time", F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.col("time_hours") * 3.6e9).cast("long")))


def run_rainfall(spark: SparkSession, terrain: DataFrame, mainstem: DataFrame, profile: DataFrame, rating: DataFrame, s: I.Screen, **storm) -> dict:
    """A storm's flood: hydrograph, sampled peak, its stage by the rating, and the screen bounded by the hydrograph's excess.

    ``warnings`` says where the peak lies beyond the rating, which is not extrapolated.
    """
    hydro = rainfall_hydrograph(spark, profile, **storm)
    top = hydro.agg(F.max("streamflow").alias("peak")).first()["peak"]
    probe = spark.range(1).select(F.lit(float(top)).alias("q"), F.lit(float(s.gauge_bank_ft)).alias("b"))
    curve = H.rating_curve(rating)
    at = H.flow_from_stage(H.stage_from_flow(probe, curve, "q"), curve, "b", "bankfull").first()
    limit = H.rating_range(curve).first()["max_flow_cfs"]
    now = replace(s, gauge_flow_cfs=float(top), gauge_stage_ft=float(at["stage_ft"]), bankfull_flow_cfs=float(at["bankfull"]))
    out = I.screen(terrain, mainstem, profile, now, hydro.select("time", F.col("streamflow").alias("flow_cfs")))
    return out | {"hydrograph": hydro, "screen": now, "warnings": ["peak_flow_exceeds_rating"] if top > limit else []}


def run_live(terrain: DataFrame, mainstem: DataFrame, profile: DataFrame, rating: DataFrame, forecast: DataFrame, s: I.Screen) -> dict:
    """The live part on stored terrain: the forecast's peak (m3/s in ``streamflow``) through rating and screen."""
    h = S.normalize_hydrograph(forecast.select("time", X.to_cfs_by_factor("streamflow", "cms").alias("flow_cfs")), ())
    top = S.peak(h.withColumn("one", F.lit(0)), ["one"], "flow_cfs")
    stage = H.stage_from_flow(top, H.rating_curve(rating), "peak_flow_cfs").first()
    now = replace(s, gauge_flow_cfs=float(stage["peak_flow_cfs"]), gauge_stage_ft=float(stage["stage_ft"]))
    return I.screen(terrain, mainstem, profile, now, h) | {"screen": now, "peak_time": stage["peak_time"]}
