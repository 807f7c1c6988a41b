"""Distance to a mask over a whole raster, without a cut-off.

The squared distance separates: first each column of the raster finds its nearest masked cell above and below, then each row
takes the lower envelope of the parabolas that stand on those.  A task holds one column's cells sorted, or one
row of the raster; each pass is one shuffle, and the work grows with the cells alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.operators.raster import CELL, Grid
from hydrospark.session import ship


def envelope(x: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of the sorted ``at``, which parabola ``h + (place - x) ** 2`` is lowest; of equals the first.  ``x`` rises."""
    top, cut = [0], [-np.inf]  # parabolas of the envelope, and where each begins
    for k in range(1, len(x)):
        while True:
            j = top[-1]
            meet = ((h[k] + x[k] ** 2) - (h[j] + x[j] ** 2)) / (2 * (x[k] - x[j]))
            if meet > cut[-1]:
                break
            top.pop()
            cut.pop()
        top.append(k)
        cut.append(meet)
    return np.array(top)[np.searchsorted(np.array(cut), at, "left") - 1]


def distance_to_mask(cells: DataFrame, mask: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` (``row, col``) with ``near_row, near_col``, the nearest cell of the mask, and ``distance_m``; null without a mask.

    Cells may be any part of a raster, and masked cells need not be among them.  Of equal distances in a column the upper cell counts, and of equal ones in a row the left one.
    """
    ship(cells.sparkSession)
    sy, sx = abs(grid[4]), abs(grid[0])
    long = lambda c: F.col(c).cast("long")
    own = cells.select(long("row").alias("row"), long("col").alias("col"), F.lit(True).alias("own"), F.lit(None).cast("long").alias("m"))
    both = own.unionByName(mask.select(long("row").alias("row"), long("col").alias("col"), F.lit(False).alias("own"), long("row").alias("m"))).groupBy(*CELL).agg(F.max("own").alias("own"), F.max("m").alias("m"))
    ends = own.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    # Looking down is looking up in the reversed column, which Spark carries on from row to row.
    above, below = W.partitionBy("col").orderBy("row"), W.partitionBy("col").orderBy(F.desc("row"))
    so_far = (W.unboundedPreceding, 0)
    seen = both.withColumns({"up": F.last("m", True).over(above.rowsBetween(*so_far)), "before": F.lag("row").over(above)}).withColumns({"down": F.last("m", True).over(below.rowsBetween(*so_far)), "under": F.last("m", True).over(below.rowsBetween(W.unboundedPreceding, -1)), "next": F.lag("row").over(below)})
    # In a column with a masked cell the rows without a cell get their nearest one too, as rows look across.
    has = F.col("up").isNotNull() | F.col("down").isNotNull()
    span = lambda a, b: F.when(has & (a <= b), F.sequence(a, b))
    rows = F.concat(F.array("row"), F.coalesce(span(F.col("row") + 1, F.coalesce(F.col("next") - 1, "last_row")), F.array().cast("array<bigint>")))
    inner = seen.join(F.broadcast(ends)).select("col", F.col("row").alias("at"), "own", "up", F.col("under").alias("down"), F.explode(rows).alias("row"))
    head = seen.join(F.broadcast(ends)).where(F.col("before").isNull()).select("col", F.col("row").alias("at"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("up"), "down", F.explode(span(F.col("first_row"), F.col("row") - 1)).alias("row"))
    r = F.col("row")
    near = F.when(F.col("down").isNull() | (r - F.col("up") <= F.col("down") - r), F.col("up")).otherwise(F.col("down"))
    by_column = inner.unionByName(head).select("row", "col", (F.col("own") & (r == F.col("at"))).alias("own"), near.alias("near_row")).where("own or near_row is not null")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col", kind="stable").reset_index(drop=True)
        has = pdf["near_row"].notna().to_numpy()
        out = pdf[["row", "col"]][pdf["own"].to_numpy()]
        if not has.any() or out.empty:
            return out.assign(near_row=pd.array([None] * len(out), "Int64"), near_col=pd.array([None] * len(out), "Int64"), distance_m=np.nan)
        some = pdf[has].drop_duplicates("col")
        x, rows = some["col"].to_numpy(float) * sx, some["near_row"].to_numpy(np.int64)
        h = ((rows - int(key[0])) * sy) ** 2
        best = envelope(x, h, out["col"].to_numpy(float) * sx)
        far = np.sqrt(h[best] + (out["col"].to_numpy(float) * sx - x[best]) ** 2)
        return out.assign(near_row=pd.array(rows[best], "Int64"), near_col=pd.array(some["col"].to_numpy(np.int64)[best], "Int64"), distance_m=far)

    kinds = dict(cells.dtypes)
    out = by_column.groupBy("row").applyInPandas(run, "row long, col long, near_row long, near_col long, distance_m double")
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in CELL], "near_row", "near_col", F.nanvl("distance_m", F.lit(None).cast("double")).alias("distance_m"))
