"""Cross sections and banks from sampled terrain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C
from hydrospark.operators import raster as R
from hydrospark.operators import series as S
from hydrospark.session import ship

FOUND = (
    "channel_distance_m double, channel_surface_elevation_ft_navd88 double, left_bank_distance_m double, left_bank_ft_navd88 double, right_bank_distance_m double, right_bank_ft_navd88 double"
)


def sample_lines(sections: DataFrame, cells: DataFrame, grid: R.Grid, keys: Sequence[str], half_width: float = 150.0, spacing: float = 1.0) -> DataFrame:
    """H22 (samples): terrain along each section, across the river: ``distance_m, x, y, elevation_m``."""
    n = int(round(half_width / spacing))
    line = sections.select(*keys, "center_x", "center_y", "cross_dx", "cross_dy", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("k")).withColumn("distance_m", F.col("k") * F.lit(float(spacing)))
    line = line.withColumns({"x": F.col("center_x") + F.col("distance_m") * F.col("cross_dx"), "y": F.col("center_y") + F.col("distance_m") * F.col("cross_dy")})
    return R.sample(line.select(*keys, "distance_m", "x", "y"), cells, "x", "y", grid, out="elevation_m")


def smoothed(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elevations in feet, bridged by row number and smoothed."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("distance_m")
    ft = samples.withColumn("elevation_ft", F.col("elevation_m") * C.M_TO_FT)
    return ft.withColumn("__f", S.fill_by_row("elevation_ft", keys, "distance_m")).withColumn("smooth_ft", S.savgol("__f", w)).drop("__f")


def peaks(y: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Places of local maxima (the middle of a plateau) at least ``distance`` apart, the higher first, with that prominence."""
    found = []
    i, n = 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = np.array(found, int)
    keep = np.ones(len(found), bool)
    for k in np.argsort(y[found], kind="stable")[::-1] if len(found) else []:
        if keep[k]:
            close = np.abs(found - found[k]) < distance
            close[k] = False
            keep &= ~close
    out = []
    for p in found[keep]:
        left = y[:p][::-1]
        right = y[p + 1 :]
        lb = left[: int(np.argmax(left > y[p]))] if (left > y[p]).any() else left
        rb = right[: int(np.argmax(right > y[p]))] if (right > y[p]).any() else right
        base = max(lb.min() if len(lb) else y[p], rb.min() if len(rb) else y[p])
        if y[p] - base >= prominence:
            out.append(p)
    return np.array(out, int)


def first_bank(distance: np.ndarray, smooth: np.ndarray, channel: int, side: int, reach: tuple[float, float] = (8.0, 65.0), least_relief: float = 6.5, prominence: float = 0.35, spacing: float = 1.0) -> int:
    """The bank on one side: the nearest high enough peak, else the nearest high flat, else the highest sample; -1 if there are too few."""
    rel = distance - distance[channel]
    idx = np.flatnonzero((side * rel >= reach[0]) & (side * rel <= reach[1]))
    if len(idx) < 5:
        return -1
    relief = smooth - smooth[channel]
    tops = idx[peaks(smooth[idx], prominence, max(3, int(round(5.0 / max(spacing, 0.1)))))]
    tops = tops[relief[tops] >= least_relief]
    if len(tops):
        return int(tops[np.argmin(np.abs(rel[tops]))])
    slope = np.gradient(smooth, distance)
    near = idx[np.argsort(np.abs(rel[idx]), kind="stable")]
    flat = near[(relief[near] >= least_relief) & (np.abs(slope[near]) <= 0.08)]
    return int(flat[0]) if len(flat) else int(idx[np.argmax(smooth[idx])])


def find_banks(samples: DataFrame, keys: Sequence[str], channel_reach: float = 35.0, spacing: float = 1.0, least_samples: int = 15, **search) -> DataFrame:
    """Channel and banks of every section; a section that cannot be read keeps a row of nulls.

    Sections are worked a group each: a few hundred samples.
    """
    ship(samples.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in samples.dtypes if n in keys)
    names = [p.split()[0] for p in FOUND.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("distance_m")
        d, z, s = (pdf[c].to_numpy(float) for c in ("distance_m", "elevation_ft", "smooth_ft"))
        row = {k: pdf[k].iloc[0] for k in keys} | dict.fromkeys(names, np.nan)
        middle = np.flatnonzero((np.abs(d) <= channel_reach) & np.isfinite(z))
        if np.isfinite(z).sum() >= least_samples and len(middle):
            ch = int(middle[np.argmin(s[middle])])
            left, right = (first_bank(d, s, ch, side, spacing=spacing, **search) for side in (-1, 1))
            if left >= 0 and right >= 0:
                row |= dict(zip(names, (d[ch], z[ch], d[left], z[left], d[right], z[right])))
        return pd.DataFrame([row])

    out = samples.select(*keys, "distance_m", "elevation_ft", "smooth_ft").groupBy(*keys).applyInPandas(run, f"{kinds}, {FOUND}")
    return out.select(*keys, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def bank_sections(sections: DataFrame, banks: DataFrame, keys: Sequence[str], seed_offset: float = 4.0) -> DataFrame:
    """Sections (with ``center_x``, ``cross_dx``, ``routing_channel_elevation_m_navd88``) with the lower bank, freeboard and flags."""
    df = sections.join(banks, list(keys), "left")
    left = F.col("left_bank_ft_navd88") <= F.col("right_bank_ft_navd88")
    pick = lambda a, b: F.when(left, a).when(~left, b)
    df = df.withColumns({
        "lower_bank_side": pick(F.lit("left"), F.lit("right")), "lower_bank_side_sign": pick(F.lit(-1.0), F.lit(1.0)),
        "lower_bank_raw_ft_navd88": pick(F.col("left_bank_ft_navd88"), F.col("right_bank_ft_navd88")), "lower_bank_distance_m": pick(F.col("left_bank_distance_m"), F.col("right_bank_distance_m")),
        "routing_channel_elevation_ft_navd88": F.col("routing_channel_elevation_m_navd88") * C.M_TO_FT,
    })
    along = lambda c, d: F.col(f"center_{c}") + d * F.col(f"cross_d{c}")
    reach = F.col("lower_bank_distance_m") + F.col("lower_bank_side_sign") * seed_offset
    df = df.withColumns({"freeboard_raw_ft": F.col("lower_bank_raw_ft_navd88") - F.col("routing_channel_elevation_ft_navd88"), "lower_bank_x": along("x", F.col("lower_bank_distance_m")), "lower_bank_y": along("y", F.col("lower_bank_distance_m")), "seed_x": along("x", reach), "seed_y": along("y", reach)})
    flags = X.section_flags("channel_distance_m", "left_bank_distance_m", "right_bank_distance_m", "left_bank_ft_navd88", "right_bank_ft_navd88", "freeboard_raw_ft")
    known = F.col("freeboard_raw_ft").isNotNull()
    return df.withColumns({"qa_flags": F.when(known, F.array_join(flags, ";")).otherwise("section_failed"), "raw_valid": F.coalesce(known & (F.size(flags) == 0), F.lit(False))})


def seeds(sections: DataFrame, terrain: DataFrame, grid: R.Grid, keys: Sequence[str], first: float = 4.0, last: float = 20.0, step: float = 2.0, least_depth: float = 0.05, passable: Column | None = None) -> DataFrame:
    """Where water leaves each overtopped section: the first cell landward of its lower bank that would be wet.

    ``terrain`` has ``row, col, ground`` and what ``passable`` needs; sections have the columns of
    bank_sections and ``scenario_wse_m_navd88, overtopped``.
    """
    n = int(round((last - first) / step))
    rays = sections.where("overtopped").select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).withColumn("seed_search_offset_m", first + F.col("k") * F.lit(float(step)))
    d = F.col("lower_bank_distance_m") + F.col("lower_bank_side_sign") * F.col("seed_search_offset_m")
    rays = rays.withColumns({"x": F.col("center_x") + d * F.col("cross_dx"), "y": F.col("center_y") + d * F.col("cross_dy")})
    cell = X.cell_of("x", "y", grid)
    met = rays.withColumns({"row": cell["row"], "col": cell["col"]}).join(terrain, R.CELL).withColumn("local_depth_m", F.col("scenario_wse_m_navd88") - F.col("ground"))
    ok = F.col("local_depth_m") >= least_depth
    if passable is not None:
        ok = ok & passable
    return S.first_satisfying(met.select(*keys, "row", "col", "x", "y", "seed_search_offset_m", "local_depth_m", *[c for c in terrain.columns if c not in ("row", "col")]), list(keys), ok, "seed_search_offset_m")
