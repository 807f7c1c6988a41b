"""The comparison bundle of a gauge (H27): a few figures from each source, each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions import columns as X

BUNDLE = "source string, figures map<string, string>, error string"


def figures(source: Callable[[], DataFrame]) -> tuple[dict[str, str], str | None]:
    """The one row that a source's summary gives, as text; what went wrong where it fails."""
    try:
        row = source().limit(1).collect()
    except (PySparkException, ValueError, OSError) as e:
        return {}, str(e).split("\n")[0]
    return {k: str(v) for k, v in row[0].asDict().items() if v is not None} if row else {}, None


def daily_figures(daily: DataFrame) -> DataFrame:
    """How many daily values there are, from when to when, their mean and largest."""
    return daily.agg(F.count("*").alias("records"), F.min("time").alias("record_start"), F.max("time").alias("record_end"), F.avg("value").alias("mean_daily"), F.max("value").alias("max_daily"))


def rain_figures(forecast: DataFrame) -> DataFrame:
    """A10: how many steps a forecast has, and its total."""
    return forecast.agg(F.count("*").alias("forecast_records"), F.coalesce(F.sum("precip_in"), F.lit(0.0)).alias("forecast_total_in"))


def peak_figures(forecast: DataFrame, other: DataFrame) -> DataFrame:
    """The peaks of two forecasts (``value_cfs``, ``streamflow``) and whether they agree."""
    peaks = forecast.agg(F.max("value_cfs").alias("forecast_peak_cfs")).join(F.broadcast(other.agg(F.max(X.number("streamflow")).alias("other_peak_cfs"))))
    both = peaks.withColumn("c", X.peak_difference("forecast_peak_cfs", "other_peak_cfs"))
    return both.select("forecast_peak_cfs", "other_peak_cfs", F.col("c.percent").alias("peak_difference_percent"), F.col("c.agreement").alias("forecast_agreement"))


def bundle(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], before: DataFrame | None = None) -> DataFrame:
    """A row for each source; one that fails leaves its message and does not stop the others.

    With ``before``, rows of sources that are not asked now stay as they were: a refresh of the live part
    keeps the history.
    """
    made = spark.createDataFrame([(name, *figures(source)) for name, source in sources.items()], BUNDLE)
    return made if before is None else made.unionByName(before.join(made.select("source"), "source", "left_anti"))
