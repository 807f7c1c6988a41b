"""Landed payloads of web services as tables.

Fetching is not the engine's work: pages are landed as files (JSON, tab-separated text, KML) and
read by Spark; each function here takes a column or a table of payloads and gives typed rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.functions import constants as C

GAUGE_PAGE = "features array<struct<properties: struct<parameter_code: string, time: string, value: string, unit_of_measure: string, approval_status: string>>>, links array<struct<rel: string, href: string>>"
LEGACY_PAGE = "value struct<timeSeries: array<struct<variable: struct<variableCode: array<struct<value: string>>>, values: array<struct<value: array<struct<dateTime: string, value: string>>>>>>>"
DAILY_PAGE = "features array<struct<properties: struct<time: string, date: string, datetime: string, value: string, parameter_code: string, statistic_id: string, unit_of_measure: string, unit: string>>>"
QPF_GRID = "properties struct<quantitativePrecipitation: struct<values: array<struct<validTime: string, value: string>>>, probabilityOfPrecipitation: struct<values: array<struct<validTime: string, value: string>>>>"
FORECASTS = "forecasts map<string, struct<forecasts: array<struct<issuedTime: string, gaugeId: string, forecastRanges: array<struct<forecastStartTime: string, forecastEndTime: string, value: double>>>>>>"
LOCATIONS = "features array<struct<id: string, geometry: struct<coordinates: array<double>>, properties: struct<monitoring_location_number: string, monitoring_location_name: string, site_type_code: string, drainage_area: double, contributing_drainage_area: double, altitude: double, altitude_accuracy: double, vertical_datum: string, vertical_datum_name: string>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``payload``, with the file as ``source``: one row a page."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("source"))


def gauge_readings(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """``time, value, parameter, unit, approval_status`` of every reading with code, time and value."""
    p = pages.select(*keys, F.explode(F.from_json(payload, GAUGE_PAGE)["features"]).alias("f")).select(*keys, "f.properties.*")
    out = p.where("parameter_code is not null and time is not null and value is not null")
    return out.select(*keys, X.moment("time").alias("time"), X.number("value").alias("value"), F.col("parameter_code").alias("parameter"), F.col("unit_of_measure").alias("unit"), "approval_status").where("time is not null and value is not null")


def next_page(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The link to the page after each, null at the end."""
    links = F.from_json(payload, GAUGE_PAGE)["links"]
    return pages.select("*", F.get(F.transform(F.filter(links, lambda x: x["rel"] == "next"), lambda x: x["href"]), F.lit(0)).alias("next"))


def legacy_readings(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """The nested form: series, blocks, values."""
    s = pages.select(*keys, F.explode(F.from_json(payload, LEGACY_PAGE)["value"]["timeSeries"]).alias("s")).select(*keys, F.get("s.variable.variableCode", F.lit(0))["value"].alias("parameter"), F.explode("s.values").alias("b"))
    v = s.select(*keys, "parameter", F.explode("b.value").alias("v"))
    return v.select(*keys, X.moment("v.dateTime").alias("time"), X.number("v.value").alias("value"), "parameter").where("time is not null and value is not null")


def first_with_rows(*sources: DataFrame) -> DataFrame:
    """The first table that has a row, marked with its number as ``source_rank``; the last if none has."""
    for k, s in enumerate(sources[:-1]):
        if s.limit(1).count():
            return s.withColumn("source_rank", F.lit(k))
    return sources[-1].withColumn("source_rank", F.lit(len(sources) - 1))


def daily_values(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """Daily means; of equal days the largest value stays."""
    p = pages.select(*keys, F.explode(F.from_json(payload, DAILY_PAGE)["features"]).alias("f")).select(*keys, "f.properties.*")
    rows = p.select(*keys, X.moment(F.coalesce("time", "date", "datetime")).alias("time"), X.number("value").alias("value"), "parameter_code", "statistic_id", F.coalesce("unit_of_measure", "unit").alias("unit")).where("time is not null and value is not null")
    rest = [c for c in rows.columns if c not in (*keys, "time")]
    return rows.groupBy(*keys, "time").agg(F.max_by(F.struct(*rest), "value").alias("r")).select(*keys, "time", "r.*")


def objects(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """every JSON object in a payload, however deep, as the variant ``obj``.

    One level at a time: what is an object or an array is exploded, the rest ends there.  How many levels
    there are is looked up first: the most brackets that are open at once, outside of strings.  Every level begins at the
    payloads, so these are spread over all tasks first.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), payload)
    brackets = F.regexp_replace(F.regexp_replace(payload, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    walk = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def take(a, c):
        now = a["open"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(a["most"], now).alias("most"))

    deep = F.aggregate(F.split(brackets, ""), walk, take, lambda a: a["most"])
    depth = pages.agg(F.max(deep).alias("d")).first()["d"] or 1
    level = pages.select(*keys, F.try_parse_json(payload).alias("obj"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("obj")
        here = level.where(F.startswith(kind, F.lit("OBJECT")))
        out = here if out is None else out.unionByName(here)
        inner = level.where(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")))
        level = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("obj").outer())).select(*keys, F.col("value").alias("obj"))
    return out


def first_key(obj: str, names: Sequence[str], kind: str = "string") -> Column:
    """the first of the keys that is there and fits."""
    return F.coalesce(*[F.try_variant_get(obj, f"$.{n}", kind) for n in names])


def streamflow(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct ``time, streamflow`` of every object that has both."""
    o = objects(pages, payload, keys)
    t = first_key("obj", ("validTime", "valid_time", "time", "forecastTime", "forecast_time", "datetime"))
    q = first_key("obj", ("streamflow", "flow", "value", "discharge"))
    return o.select(*keys, X.moment(t).alias("time"), X.number(q).alias("streamflow")).where("time is not null and streamflow is not null").distinct()


def rating_points(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct ``stage_ft, flow_cfs`` with flows of 0 or more."""
    o = objects(pages, payload, keys)
    h = first_key("obj", ("stage", "stageValue", "gageHeight", "height"))
    q = first_key("obj", ("flow", "flowValue", "discharge", "streamflow"))
    return o.select(*keys, X.number(h).alias("stage_ft"), X.number(q).alias("flow_cfs")).where("stage_ft is not null and flow_cfs >= 0").distinct()


def flood_status(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """severity and gauge of every object that looks like a flood status."""
    o = objects(pages, payload, keys)
    sev, gid = F.try_variant_get("obj", "$.severity", "string"), F.try_variant_get("obj", "$.gaugeId", "string")
    has_map = F.try_variant_get("obj", "$.inundationMapSet", "variant").isNotNull()
    return o.select(*keys, sev.alias("severity"), gid.alias("gauge_id"), F.try_variant_get("obj", "$.forecastTrend", "string").alias("forecast_trend"), has_map.alias("__m")).where("severity is not null and (__m or gauge_id is not null)").drop("__m")


def rating_table(lines: DataFrame, keys: Sequence[str] = (), line: str = "line", number: str = "n") -> DataFrame:
    """``gage_height_ft, shift_ft, flow_cfs`` of a tab-separated rating table.

    ``lines`` has each file's lines with their numbers; the header is the line that begins with
    INDEP, and what follows is data.  Lines that are no numbers drop out, as do negative flows;
    of equal heights the least flow stays.
    """
    w = W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, 0)
    cells = F.split(line, "\t")
    head = F.when(F.trim(F.get(cells, F.lit(0))) == "INDEP", cells)
    rows = lines.select(*keys, F.col(number).alias("__n"), cells.alias("__c"), F.last(head, ignorenulls=True).over(w).alias("__h"))
    at = lambda name: F.get("__c", F.array_position("__h", name).cast("int") - 1)
    has_shift = F.array_contains("__h", "SHIFT")
    out = rows.where("__h is not null").select(*keys, X.number(at("INDEP")).alias("gage_height_ft"), F.when(has_shift, X.number(at("SHIFT"))).otherwise(0.0).alias("shift_ft"), X.number(at("DEP")).alias("flow_cfs"))
    ok = out.where("gage_height_ft is not null and flow_cfs >= 0")
    return ok.groupBy(*keys, "gage_height_ft").agg(F.min_by(F.struct("shift_ft", "flow_cfs"), "flow_cfs").alias("r")).select(*keys, "gage_height_ft", "r.*")


def rainfall_forecast(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """``time, duration_hours, precip_mm, precip_in``; a missing duration is null."""
    v = pages.select(*keys, F.explode(F.from_json(payload, QPF_GRID)["properties"]["quantitativePrecipitation"]["values"]).alias("v"))
    t = X.valid_time("v.validTime")
    return v.select(*keys, t["start"].alias("time"), F.when(t["seconds"] > 0, t["seconds"] / 3600.0).alias("duration_hours"), X.number("v.value").alias("precip_mm")).where("time is not null and precip_mm is not null").withColumn("precip_in", F.col("precip_mm") / C.MM_PER_IN)


def rain_probability(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """``time, probability_percent``."""
    v = pages.select(*keys, F.explode(F.from_json(payload, QPF_GRID)["properties"]["probabilityOfPrecipitation"]["values"]).alias("v"))
    return v.select(*keys, X.valid_time("v.validTime")["start"].alias("time"), X.number("v.value").alias("probability_percent")).where("time is not null and probability_percent is not null")


def forecasts(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = (), unit: str | None = None) -> DataFrame:
    """Forecast ranges of every gauge; with m3/s also ``value_cfs``."""
    m = pages.select(*keys, F.explode(F.from_json(payload, FORECASTS)["forecasts"]).alias("g", "s")).select(*keys, "g", F.explode("s.forecasts").alias("f")).select(*keys, "g", "f", F.explode("f.forecastRanges").alias("r"))
    out = m.select(*keys, F.coalesce("f.gaugeId", "g").alias("gauge_id"), X.moment("f.issuedTime").alias("issued_time"), X.moment("r.forecastStartTime").alias("forecast_start"), X.moment("r.forecastEndTime").alias("forecast_end"), F.col("r.value").alias("value"))
    return out.withColumn("value_cfs", F.col("value") * C.CMS_TO_CFS) if unit == "CUBIC_METERS_PER_SECOND" else out


def monitoring_locations(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = (), box: Column | None = None) -> DataFrame:
    """Stream gauges (site types ST...) with their numbers, inside a box of degrees if one is given."""
    f = pages.select(*keys, F.explode(F.from_json(payload, LOCATIONS)["features"]).alias("f"))
    out = f.select(*keys, X.site_number(F.coalesce("f.properties.monitoring_location_number", "f.id")).alias("site_no"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), "f.properties.*").where(F.startswith("site_type_code", F.lit("ST")))
    if box is not None:
        out = out.where(F.col("lon").between(box["west"], box["east"]) & F.col("lat").between(box["south"], box["north"]))
    return out


def location(payload: str) -> Column:
    """(lat, lon) of a gauge object, wherever it keeps them."""
    v = F.try_parse_json(payload)
    at = lambda part: F.coalesce(*[F.try_variant_get(v, f"$.{p}{part}", "double") for p in ("location.", "latLng.", "latlng.", "")])
    return F.struct(at("latitude").alias("lat"), at("longitude").alias("lon"))


def kml_rings(pages: DataFrame, kml: str = "kml", keys: Sequence[str] = ()) -> DataFrame:
    """A closed ring of {x, y} for every ``coordinates`` element with four points or more."""
    text = F.explode(F.xpath(kml, F.lit('//*[substring(local-name(), string-length(local-name()) - 10) = "coordinates"]/text()')))
    points = F.transform(F.filter(F.split(F.trim("t"), r"\s+"), lambda p: F.size(F.split(p, ",")) >= 2), lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))
    rings = pages.select(*keys, text.alias("t")).select(*keys, F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("ring")).where(F.size("ring") >= 4)
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return rings.withColumn("ring", closed)


def geojson_features(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``geom_type, rings, properties`` of a feature collection; empty geometries drop out."""
    v = pages.select(*keys, F.try_parse_json(payload).alias("v"))
    f = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.features", "variant"))).select(*keys, F.col("value").alias("f"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    poly = F.transform(F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<double>>>"), lambda r: F.transform(r, pair))
    multi = F.transform(F.flatten(F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<array<double>>>>")), lambda r: F.transform(r, pair))
    line = F.array(F.transform(F.try_variant_get("f", "$.geometry.coordinates", "array<array<double>>"), pair))
    point = F.array(F.array(pair(F.try_variant_get("f", "$.geometry.coordinates", "array<double>"))))
    rings = F.when(kind.isin("Polygon", "MultiLineString"), poly).when(kind == "MultiPolygon", multi).when(kind == "LineString", line).when(kind == "Point", point)
    out = f.select(*keys, kind.alias("geom_type"), rings.alias("rings"), F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("properties")).where("rings is not null and size(rings) > 0 and size(rings[0]) > 0")
    return out if where is None else out.where(where)


def metadata(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """What a gauge's or a reach's record says of itself; records that are no objects drop out."""
    v = pages.select(*keys, F.try_parse_json(payload).alias("obj")).where(F.startswith(F.schema_of_variant("obj"), F.lit("OBJECT")))
    at = lambda *names, kind="string": first_key("obj", names, kind)
    return v.select(*keys, at("lid", "gaugeId").alias("gauge_id"), at("usgsId", "usgs_id").alias("site_no"), at("reachId", "reach_id").alias("reach_id"), at("name").alias("name"), at("latitude", kind="double").alias("lat"), at("longitude", kind="double").alias("lon"))


def reach_ids(pages: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """The reach of a site: the first feature's ``comid``, or its ``nhdplus_comid``; empty ones are null."""
    v = F.try_parse_json(payload)
    at = lambda n: F.nullif(F.try_variant_get(v, f"$.features[0].properties.{n}", "string"), F.lit(""))
    return pages.select(*keys, F.coalesce(at("comid"), at("nhdplus_comid")).alias("reach_id"))
