"""Ratings of many gauges on one datum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import hydraulics as H

#: How far the present level may lie from the channel.
TOLERANCE_FT = 10.0


def datums(gauges: DataFrame, tolerance_ft: float = TOLERANCE_FT) -> DataFrame:
    """The datum of every gauge, ``datum_ft``, with ``datum_status`` and ``stage_vs_channel_ft``.

    ``gauges`` has ``site_no, altitude, vertical_datum, override_ft, stage_ft`` (now, may be null) and
    ``channel_ft``.  An override goes first, then a height on NAVD88.  Where the present level would lie further than the
    tolerance from the channel, the datum is not taken and the status says so.
    """
    known = X.datum_candidate("altitude", "vertical_datum")
    df = gauges.withColumn("__c", known).withColumn("__d", F.coalesce(X.number("override_ft"), F.col("__c.value")))
    gap = F.col("__d") + X.number("stage_ft") - X.number("channel_ft")
    far = F.coalesce(F.abs(gap) > tolerance_ft, F.lit(False))
    status = F.when(far, "datum_inconsistent_with_channel").when(X.number("override_ft").isNotNull(), "manual_navd88_override").otherwise(F.col("__c.status"))
    return df.select(*gauges.columns, F.when(~far, F.col("__d")).alias("datum_ft"), status.alias("datum_status"), gap.alias("stage_vs_channel_ft"))


def absolute_ratings(points: DataFrame, gauges: DataFrame, vetted: DataFrame | None = None, tolerance_ft: float = TOLERANCE_FT) -> DataFrame:
    """Rating curves (``site_no, flow_cfs, stage_ft``) of all gauges whose datum is accepted, with ``datum_status``.

    ``points`` has ``site_no, gage_height_ft, flow_cfs``; a gauge in ``vetted`` keeps the curve that it has there.
    """
    found = datums(gauges, tolerance_ft)
    sites = None if vetted is None else vetted.select("site_no").distinct()
    if sites is not None:
        found = found.join(sites, "site_no", "left_anti")
    ok = found.where("datum_ft is not null").select("site_no", "datum_ft", "datum_status")
    curves = H.rating_curve(H.absolute_rating(points.join(ok.select("site_no", "datum_ft"), "site_no"), "datum_ft"), ["site_no"])
    out = curves.join(ok.select("site_no", "datum_status"), "site_no").select("site_no", "flow_cfs", "stage_ft", "datum_status")
    if vetted is not None:
        out = out.unionByName(vetted.select("site_no", "flow_cfs", "stage_ft", F.lit("vetted_existing_pilot").alias("datum_status")))
    return out
