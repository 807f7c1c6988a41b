"""Files in and out: explicit schemas in, partitioned Parquet, CSV, JSON and GeoJSON out."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C

HYDROGRAPH = "time timestamp, flow_cfs double"
HIGH_WATER_MARKS = "latitude double, longitude double, wse_ft_navd88 double, hwm_id string"
RATING = "flow_cfs double, stage_ft double, gage_height_ft double"
STAGE_CONTROLS = "station_m double, stage_ft_navd88 double, gauge_id string, network string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and a declared schema; what does not fit is null."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").schema(schema).csv(path)


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, tile: int = 512) -> DataFrame:
    """A raster's cells; a window is pruned to the tiles that it touches."""
    df = spark.read.parquet(path)
    for axis, span in (("row", rows), ("col", cols)):
        if span:
            df = df.where(F.col(f"tile_{axis}").between(span[0] // tile, span[1] // tile) & F.col(axis).between(*span))
    return df


def write_cells(cells: DataFrame, path: str, value: str = "value", tile: int = 512) -> None:
    """A float raster as Parquet by tile; cells without data are not written."""
    v = X.number(value)
    out = cells.select("row", "col", F.when(v != C.RASTER_NODATA, v).cast("float").alias(value), F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col")).where(F.col(value).isNotNull())
    out.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.mode("overwrite").partitionBy("tile_row", "tile_col").option("compression", "zstd").parquet(path)


def write_mask(cells: DataFrame, path: str) -> None:
    """The cells that are in."""
    cells.select("row", "col").distinct().write.mode("overwrite").option("compression", "zstd").parquet(path)


def feature(geometry: str, rings: Column | str, properties: list[str]) -> Column:
    """A GeoJSON feature as text; coordinates must be degrees."""
    pairs = F.transform(X.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    shape = {"Polygon": pairs, "LineString": F.get(pairs, F.lit(0)), "Point": F.get(F.get(pairs, F.lit(0)), F.lit(0))}[geometry]
    props = F.struct(*properties) if properties else F.create_map().cast("map<string,string>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(geometry).alias("type"), shape.alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def write_geojson(features: DataFrame, path: str, text: str = "feature") -> None:
    """One feature a line, in as many files as there are partitions; an empty table gives an empty folder."""
    features.select(text).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, text: str = "feature", most: int = 100_000) -> str:
    """A small result as one GeoJSON document; an empty one is valid.  Fails beyond ``most`` features."""
    rows = features.select(text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} features: write them with write_geojson")
    return '{"type": "FeatureCollection", "features": [' + ",".join(r[0] for r in rows) + "]}"


def write_csv(df: DataFrame, path: str) -> None:
    """K04."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Quality records."""
    df.write.mode("overwrite").json(path)


def save_cache(df: DataFrame, path: str, source: str) -> None:
    """A cache that knows where it is from and when it was made."""
    df.withColumns({"cache_source": F.lit(source), "cached_at": F.current_timestamp()}).write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str, time: str = "time") -> DataFrame:
    """The cache with clean times; how old it is stays visible."""
    return spark.read.parquet(path).withColumn(time, X.moment(time)).where(F.col(time).isNotNull())


def list_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """An index of stored files: ``key, name, bytes``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("key"), X.base_name("path").alias("name"), F.col("length").alias("bytes"))


def recent(entries: DataFrame, modified: str, has_state: str, n: int = 20) -> DataFrame:
    """The ``n`` entries changed last, of those that have a state."""
    return entries.where(has_state).orderBy(F.desc(modified), *[c for c in entries.columns if c != modified][:1]).limit(n)


@dataclass(frozen=True)
class Workspace:
    """Where a study's tables lie, and its settings over the defaults."""

    root: str
    name: str
    settings: dict = field(default_factory=dict)

    @property
    def slug(self) -> str:
        import re

        return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", self.name.strip().lower()))[:80] or C.EMPTY_SLUG

    def path(self, table: str) -> str:
        return str(Path(self.root) / f"workspace={self.slug}" / table) if "://" not in self.root else f"{self.root.rstrip('/')}/workspace={self.slug}/{table}"


def deep_merge(base: dict, over: dict) -> dict:
    """Nested settings; the right side wins."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
