"""Comparison of models with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import raster as R
from hydrospark.operators import series as S


def validate_extent(model: DataFrame, reference: DataFrame, grid: R.Grid, model_from: float = 0.05, reference_from: float = 0.05, area: DataFrame | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(confusion cells, scores) of a depth raster against a reference on the same grid.

    Only cells that the model knows count, inside ``area`` and outside ``exclude`` where given.
    """
    cells = R.masked(model.select("row", "col", F.col("value").alias("m")).where("m is not null"), keep=[area] if area is not None else [], drop=[exclude] if exclude is not None else [])
    both = R.overlay(cells, reference.select("row", "col", F.col("value").alias("r")), how="left")
    coded = R.confusion(both, F.col("m") >= model_from, F.col("r") >= reference_from)
    return coded.select("row", "col", "code"), R.extent_scores(coded, grid)


def validate_marks(marks: DataFrame, levels: DataFrame, grid: R.Grid, x: str, y: str, observed: str, unit: str = "ft") -> tuple[DataFrame, DataFrame]:
    """(marks with errors, summary) of high-water marks against a raster of levels in metres."""
    seen = R.sample(marks, levels, x, y, grid, out="modeled_wse_m").withColumn("observed_wse_m", X.level_to_m(X.number(observed), unit))
    return seen.withColumn("error_m", F.col("modeled_wse_m") - F.col("observed_wse_m")), S.point_errors(seen, "observed_wse_m", "modeled_wse_m")


def validate_hydrograph(modeled: DataFrame, observed: DataFrame, by: list[str], tolerance_minutes: float = 30.0, modeled_unit: str = "cfs", observed_unit: str = "cfs") -> tuple[DataFrame, DataFrame]:
    """(pairs with errors, skill) of two hydrographs."""
    clean = lambda df, u: S.normalize_hydrograph(df.withColumn("flow_cfs", X.to_cfs_by_factor(S.resolve(df, S.FLOW_NAMES), u)), by)
    obs = clean(observed, observed_unit).withColumnRenamed("flow_cfs", "observed_cfs")
    mod = clean(modeled, modeled_unit).withColumnRenamed("flow_cfs", "modeled")
    pairs = S.asof_nearest(obs, mod, "modeled", by, tolerance_seconds=tolerance_minutes * 60.0).withColumnRenamed("modeled_nearest", "modeled_cfs")
    return pairs.withColumn("error_cfs_model_minus_obs", F.col("modeled_cfs") - F.col("observed_cfs")), S.hydrograph_skill(pairs, by)
