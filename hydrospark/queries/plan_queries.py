"""Plans over the driver's tables: ratings, areas, the catalogue and the screens, with SQL where it can tell them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hydrospark.operators import hydraulics as H
from hydrospark.operators import raster as R
from hydrospark.plans import area as A
from hydrospark.plans import bundle as B
from hydrospark.plans import inundation as I
from hydrospark.plans import ratings as P
from hydrospark.plans import scenario as Sc
from hydrospark.queries.hydraulic_queries import FREEBOARD_SQL, _profile
from hydrospark.queries.raster_queries import _C, CLIP_SQL, GRID, NCOLS, POLYGON, _cells
from hydrospark.queries.series_queries import _rounded
from hydrospark.session import table
from hydrospark.sources import payloads as L
from hydrospark.sources import tables as T


def rating_for_gauges(spark, d):
    """Nations as gauges, their suppliers as rating points; nation 0 has a vetted curve."""
    k = F.col("n_nationkey")
    gauges = table(spark, d, "nation").select(
        k.alias("site_no"), F.when(k % 5 != 4, 40.0 + k).alias("altitude"), F.element_at(F.array(*map(F.lit, ("NAVD88", "NGVD29", "local", "NAVD 1988"))), (k % 4 + 1).cast("int")).alias("vertical_datum"),
        F.when(k % 7 == 3, 55.0).alias("override_ft"), F.when(k % 11 != 10, (k % 6).cast("double")).alias("stage_ft"), (41.0 + k * 1.3).alias("channel_ft"),
    )
    points = table(spark, d, "supplier").select(F.col("s_nationkey").alias("site_no"), (F.col("s_acctbal") / 500.0).alias("gage_height_ft"), F.col("s_suppkey").cast("double").alias("flow_cfs"))
    vetted = points.where("site_no = 0").select("site_no", "flow_cfs", F.col("gage_height_ft").alias("stage_ft"))
    return _rounded(P.absolute_ratings(points, gauges, vetted), 5)


RATING_SQL = """WITH g AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 != 4 THEN 40.0 + n_nationkey END AS alt, CASE WHEN n_nationkey % 7 = 3 THEN 55.0 END AS o, CASE WHEN n_nationkey % 11 != 10 THEN n_nationkey % 6 END AS st, 41.0 + n_nationkey * 1.3 AS ch FROM nation),
c AS (SELECT *, coalesce(o, CASE WHEN k % 4 IN (0, 3) THEN alt END) AS datum FROM g),
ok AS (SELECT k, datum, CASE WHEN o IS NOT NULL THEN 'manual_navd88_override' ELSE 'provisional_navd88_metadata' END AS status FROM c WHERE datum IS NOT NULL AND NOT coalesce(abs(datum + st - ch) > 10.0, false) AND k != 0),
p AS (SELECT s_nationkey AS k, CAST(s_suppkey AS DOUBLE) AS q, s_acctbal / 500.0 AS h FROM supplier),
n AS (SELECT k FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT k AS site_no, q AS flow_cfs, round(h + datum, 5) AS stage_ft, status AS datum_status FROM p JOIN ok USING (k) JOIN n USING (k)
UNION ALL SELECT k, q, round(h, 5), 'vetted_existing_pilot' FROM p WHERE k = 0"""


def bank_along(spark, d):
    """The bank at stations half a unit down from every section."""
    profile = H.finalize_freeboard(_profile(spark, d).drop("lower_bank_final_ft_navd88"))
    path = _profile(spark, d).select("workspace_id", "section_id", (F.col("station_m") + 0.5).alias("station_m"))
    return _rounded(H.bank_along(path, profile).select("workspace_id", "section_id", "bank_m"), 5)


BANK_SQL = FREEBOARD_SQL[: FREEBOARD_SQL.rindex("SELECT")] + """, u AS (SELECT workspace_id, station_m AS x0, min((bed + fin) * 0.3048) AS y0 FROM f9 WHERE bed + fin IS NOT NULL GROUP BY 1, 2),
seg AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM u WINDOW w AS (PARTITION BY workspace_id ORDER BY x0)),
e AS (SELECT workspace_id, min(x0) AS lo, max(x0) AS hi FROM u GROUP BY 1),
q AS (SELECT p.workspace_id, section_id, least(greatest(station_m + 0.5, lo), hi) AS q FROM p LEFT JOIN e USING (workspace_id))
SELECT q.workspace_id, section_id, round(y0 + coalesce((y1 - y0) * (q - x0) / (x1 - x0), 0.0), 5) AS bank_m FROM q ASOF LEFT JOIN seg ON q.workspace_id = seg.workspace_id AND q.q >= seg.x0"""


def resolutions(spark, d):
    """The resolution for a box of every customer."""
    c = table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") * 3.0).alias("w"), (F.col("c_custkey") * 40.0).alias("h"))
    return R.adaptive_resolution(c, "w", "h", 2.0, 1_000_000).select("c_custkey", "chosen_resolution_m", "estimated_bbox_cells", "adaptive")


RESOLUTION_SQL = """WITH c AS (SELECT c_custkey, greatest(abs(c_acctbal) * 3.0, 1.0) * greatest(c_custkey * 40.0, 1.0) AS a FROM customer),
r AS (SELECT *, coalesce(list_filter([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0], lambda s: a / (s * s) <= 1000000)[1], 20.0) AS s FROM c)
SELECT c_custkey, CAST(s AS DOUBLE) AS chosen_resolution_m, CAST(floor(a / (s * s)) AS BIGINT) AS estimated_bbox_cells, s > 2.0 AS adaptive FROM r"""


def _squares(spark, d):
    k = F.col("c_custkey")
    x, y, h = 1000.0 + (k * 7) % 140, 5000.0 - (k * 13) % 2100, 5.0 + k % 10
    point = lambda a, b: F.struct((x + a * h).alias("x"), (y + b * h).alias("y"))
    return table(spark, d, "customer").select("c_custkey", F.array(F.array(point(-1, -1), point(1, -1), point(1, 1), point(-1, 1), point(-1, -1))).alias("rings"))


def area_context(spark, d):
    """A square around a place for every customer, against the grid, a gauge, a basin and a mainstem."""
    n = table(spark, d, "embeddings").count()
    cells = _cells(spark, d)
    out = A.context(_squares(spark, d), ["c_custkey"], (1000.0, 5000.0 - 2.0 * n, 1000.0 + 2.0 * NCOLS, 5000.0), (1064.0, 4950.0), GRID, cells.where("value > 0.1"), cells.where("col = 32"))
    return _rounded(out.withColumn("warnings", F.array_join("warnings", ";")), 5)


CONTEXT_SQL = _C + """, s AS (SELECT c_custkey, 1000.0 + (c_custkey * 7) % 140 AS x, 5000.0 - (c_custkey * 13) % 2100 AS y, 5.0 + c_custkey % 10 AS h FROM customer),
n AS (SELECT 5000.0 - 2.0 * count(*) AS bottom FROM embeddings),
p AS (SELECT row, col, value, 1000.0 + (col + 0.5) * 2.0 AS px, 5000.0 - (row + 0.5) * 2.0 AS py FROM cells),
m AS (SELECT c_custkey, count(*) FILTER (value > 0.1) * 4.0 AS basin, bool_or(col = 32) AS main FROM s JOIN p ON px BETWEEN x - h AND x + h AND py BETWEEN y - h AND y + h GROUP BY 1),
k AS (SELECT c_custkey, 4.0 * h * h AS a, greatest(least(x + h, 1128.0) - greatest(x - h, 1000.0), 0.0) * greatest(least(y + h, 5000.0) - greatest(y - h, bottom), 0.0) AS cov, sqrt(pow(greatest(abs(x - 1064.0) - h, 0.0), 2) + pow(greatest(abs(y - 4950.0) - h, 0.0), 2)) AS dist, coalesce(basin, 0.0) AS b, coalesce(main, false) AS t FROM s CROSS JOIN n LEFT JOIN m USING (c_custkey)),
j AS (SELECT *, cov / a AS c, b / a AS o FROM k)
SELECT c_custkey, round(a, 5) AS area_m2, dist = 0 AS gauge_inside_aoi, round(dist, 5) AS gauge_distance_to_aoi_m, true AS gauge_inside_dem, round(c, 5) AS aoi_dem_coverage_fraction, round(o, 5) AS aoi_overlap_with_basin_fraction, t AS aoi_intersects_mainstem,
  array_to_string(list_filter([CASE WHEN c < 0.999 THEN 'aoi_not_fully_covered_by_dem' END, CASE WHEN o < 0.5 THEN 'aoi_has_less_than_50pct_overlap_with_gauge_upstream_basin' END, CASE WHEN NOT t THEN 'aoi_does_not_intersect_current_mainstem' END, CASE WHEN dist > 0 THEN 'gauge_outside_display_aoi_but_can_be_used_if_same_hydraulic_network' END], lambda w: w IS NOT NULL), ';') AS warnings,
  CASE WHEN c < 0.95 THEN 'model_domain_needs_expansion' WHEN o < 0.1 THEN 'current_gauge_basin_probably_not_applicable' ELSE 'supported' END AS status FROM j"""


def inside_area(spark, d):
    """The grid as depths inside a polygon: summary."""
    ring = F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POLYGON]))
    one = table(spark, d, "region").where("r_regionkey = 0").select(ring.alias("rings"))
    return _rounded(A.inside_area(_cells(spark, d), one, GRID)["summary"], 5)


AREA_SQL = CLIP_SQL[: CLIP_SQL.rindex("SELECT")] + """, v AS (SELECT value FROM cells JOIN k USING (row, col) WHERE inside AND value >= 0.05)
SELECT count(*) AS pixels, round(count(*) * 4.0, 5) AS area_m2, round(count(*) * 4.0 / 2589988.110336, 5) AS area_sqmi, round(coalesce(sum(value * 4.0), 0.0), 5) AS volume_m3, round(coalesce(max(value), 0.0), 5) AS max_value, round(coalesce(avg(value), 0.0), 5) AS mean_value, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99 FROM v"""


def regional_catalog(spark, d):
    """Suppliers as channels, customers as streams (short lines), nations as square counties."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    k, s, n = F.col("c_custkey"), F.col("s_suppkey"), F.col("n_nationkey")
    x, y = (k * 37 % 1000) / 100.0, (k * 91 % 1000) / 100.0
    streams = table(spark, d, "customer").select(k.alias("id"), F.when(k % 9 != 0, F.col("c_name")).alias("name"), (k % 6).alias("stream_order"), F.element_at(F.array(*map(F.lit, (460, 558, 336, 468, 428))), (k % 5 + 1).cast("int")).alias("ftype"), F.array(point(x, y), point(x + 0.4, y), point(x + 0.4, y + 0.3)).alias("line"))
    channels = table(spark, d, "supplier").select(s.alias("id"), F.when(s % 4 != 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("fname"), F.when(s % 3 == 0, "Major").otherwise("Minor").alias("kind"), F.array(point(F.lit(0.0), F.lit(0.0)), point(F.lit(1.0), F.lit(1.0))).alias("line"))
    cx, cy = (n % 5) * 2.0, F.floor(n / 5) * 2.0
    counties = table(spark, d, "nation").select(F.array(F.array(point(cx, cy), point(cx + 1.0, cy), point(cx + 1.0, cy + 1.0), point(cx, cy + 1.0), point(cx, cy))).alias("rings"))
    return A.regional_catalog(counties, channels, streams).select("id", "display_name", "source")


CATALOG_SQL = """WITH s AS (SELECT c_custkey AS id, c_name, (c_custkey * 37 % 1000) / 100.0 AS x, (c_custkey * 91 % 1000) / 100.0 AS y FROM customer WHERE c_custkey % 9 != 0 AND c_custkey % 6 >= 3 AND c_custkey % 5 != 4),
n AS (SELECT (n_nationkey % 5) * 2.0 AS cx, (n_nationkey // 5) * 2.0 AS cy FROM nation)
SELECT s_suppkey AS id, s_name AS display_name, 'channel' AS source FROM supplier WHERE s_suppkey % 4 != 0 AND s_suppkey % 3 = 0
UNION ALL SELECT DISTINCT id, c_name, 'stream' FROM s, n WHERE (y BETWEEN cy AND cy + 1 AND x <= cx + 1 AND x + 0.4 >= cx) OR (x + 0.4 BETWEEN cx AND cx + 1 AND y <= cy + 1 AND y + 0.3 >= cy)"""


def gauge_metadata(spark, d):
    """Records of suppliers, every third a reach, every seventh broken."""
    k = F.col("s_suppkey")
    body = F.when(k % 7 == 0, "[1, 2").otherwise(F.to_json(F.struct(F.when(k % 3 != 0, F.col("s_name")).alias("lid"), F.lpad(k.cast("string"), 8, "0").alias("usgsId"), F.when(k % 3 == 0, k.cast("string")).alias("reachId"), F.col("s_name").alias("name"), (k / 100.0).alias("latitude"))))
    return _rounded(L.metadata(table(spark, d, "supplier").select("s_suppkey", body.alias("payload")), keys=["s_suppkey"]), 5)


METADATA_SQL = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 != 0 THEN s_name END AS gauge_id, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS site_no, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS reach_id, s_name AS name, round(s_suppkey / 100.0, 5) AS lat, CAST(NULL AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 7 != 0"


def reach_ids(spark, d):
    """S15."""
    k = F.col("c_custkey")
    prop = F.struct(F.when(k % 3 == 0, "").when(k % 3 == 1, k.cast("string")).alias("comid"), F.when(k % 2 == 0, F.concat(F.lit("n"), k)).alias("nhdplus_comid"))
    body = F.to_json(F.struct(F.when(k % 5 == 0, F.array()).otherwise(F.array(F.struct(prop.alias("properties")))).alias("features")))
    return L.reach_ids(table(spark, d, "customer").select("c_custkey", body.alias("payload")), keys=["c_custkey"])


REACH_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey END AS reach_id FROM customer"


def recent_orders(spark, d):
    """The twenty orders changed last, of those that are finished."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return T.recent(o, "o_orderdate", "o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("modified"))


RECENT_SQL = "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS modified FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"


def candidate_by_id(spark, d):
    """The supplier of one number among candidates that come twice."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("site_no"), F.col("s_name").alias("name"), F.explode(F.array(F.lit(2.0), F.lit(1.0))).alias("score"))
    return A.by_id(s, "7")


#: A gauge at the foot of the valley below.
FLOW, STAGE_OVER_BANK, FULL = 900.0, 3.0, 300.0


def _valley(spark, d):
    """The grid as a valley: terrain with the table's values as roughness, the middle column as mainstem, every row a section."""
    n = table(spark, d, "embeddings").count()
    off, bed = F.abs(F.col("col") - 32), 10.0 + 0.05 * (n - 1 - F.col("row"))
    rise = F.when(off <= 8, 0.35 * off).otherwise(2.8 + 0.03 * (off - 8))
    hand = rise + F.when(off > 8, F.abs("value") * 0.05).otherwise(0.0)
    terrain = _cells(spark, d).select("row", "col", (bed + hand).alias("ground"), hand.alias("hand"), F.lit(0.0).alias("fill_depth"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"))
    ft = bed * 3.280839895
    profile = rows.select(
        F.lit(0).alias("workspace_id"), (n - 1 - F.col("row")).alias("section_id"), (2.0 * (n - 1 - F.col("row"))).alias("station_m"), F.lit(1065.0).alias("center_x"), (4999.0 - 2.0 * F.col("row")).alias("center_y"), F.lit(1.0).alias("cross_dx"), F.lit(0.0).alias("cross_dy"),
        F.lit(-16.0).alias("left_bank_distance_m"), F.lit(16.0).alias("right_bank_distance_m"), F.lit(16.0).alias("lower_bank_distance_m"), F.lit(1.0).alias("lower_bank_side_sign"), (60.0 / (1.0 + (n - 1 - F.col("row")) / 400.0)).alias("upstream_area_km2"), F.lit(30.0).alias("bankfull_conveyance_index"),
        ft.alias("routing_channel_elevation_ft_navd88"), bed.alias("routing_channel_elevation_m_navd88"), (ft + 2.8 * 3.280839895).alias("lower_bank_final_ft_navd88"),
    )
    bank = (10.0 + 2.8) * 3.280839895
    s = I.Screen(GRID, n, NCOLS, FLOW, bank + STAGE_OVER_BANK, FULL, bank, 10.0 * 3.280839895, 60.0, max_hand_m=20.0, min_component_pixels=3, duration_hours=0.05, section_reach_m=80.0)
    return terrain, terrain.where("col = 32").select("row", "col"), profile, s


def inundation_screen(spark, d):
    """Depths of a flood over the valley."""
    terrain, mainstem, profile, s = _valley(spark, d)
    return _rounded(I.screen(terrain, mainstem, profile, s)["depth"], 5)


def _rating(spark):
    return spark.range(41).select((F.col("id") * 50.0).alias("flow_cfs"), (10.0 * 3.280839895 + F.sqrt(F.col("id") * 50.0) * 0.55).alias("stage_ft"))


def rainfall_screen(spark, d):
    """A storm over the valley: summary of its flood and whether its peak is beyond the rating."""
    terrain, mainstem, profile, s = _valley(spark, d)
    out = Sc.run_rainfall(spark, terrain, mainstem, profile, _rating(spark), s, rainfall_in=6.0, duration_hours=4.0, basin_sqmi=1.5, wetness="wet")
    return _rounded(I.summary(out, terrain, out["screen"]).withColumn("warnings", F.lit(";".join(out["warnings"]))), 5)


def live_screen(spark, d):
    """A forecast (the events of one station, as m3/s) over the stored valley: summary of its flood."""
    terrain, mainstem, profile, s = _valley(spark, d)
    first = table(spark, d, "events").agg(F.min("user_id")).first()[0]
    forecast = table(spark, d, "events").where(F.col("user_id") == first).select(F.col("ts").cast("timestamp").alias("time"), (F.col("value") / 3.0).alias("streamflow"))
    out = Sc.run_live(terrain, mainstem, profile, _rating(spark), forecast, replace(s, gauge_flow_cfs=0.0))
    return _rounded(I.summary(out, terrain, out["screen"]).withColumn("peak_time", F.lit(str(out["peak_time"]))), 5)


def comparison_bundle(spark, d):
    """Figures of four sources of which one fails."""
    e = table(spark, d, "events").select(F.col("ts").alias("time"), "value", "event_type")
    view, click = (e.where(F.col("event_type") == t) for t in ("view", "click"))
    sources = {
        "daily": lambda: B.daily_figures(e).select("records", F.round("max_daily", 4).alias("max_daily")),
        "rain": lambda: B.rain_figures(view.select((F.col("value") / 100.0).alias("precip_in"))).select("forecast_records", F.round("forecast_total_in", 4).alias("total")),
        "forecast": lambda: B.peak_figures(view.select(F.col("value").alias("value_cfs")), click.select(F.col("value").alias("streamflow"))).select("forecast_agreement"),
        "broken": lambda: table(spark, d, "no_such_table"),
    }
    out = B.bundle(spark, sources)
    return out.select("source", F.explode_outer("figures").alias("figure", "value"), F.col("error").isNotNull().alias("failed"))


BUNDLE_SQL = """WITH v AS (SELECT max(value) FILTER (event_type = 'view') AS g, max(value) FILTER (event_type = 'click') AS n FROM events)
SELECT 'daily' AS source, 'records' AS figure, CAST(count(*) AS VARCHAR) AS value, false AS failed FROM events
UNION ALL SELECT 'daily', 'max_daily', CAST(round(max(value), 4) AS VARCHAR), false FROM events
UNION ALL SELECT 'rain', 'forecast_records', CAST(count(*) AS VARCHAR), false FROM events WHERE event_type = 'view'
UNION ALL SELECT 'rain', 'total', CAST(round(sum(value / 100.0), 4) AS VARCHAR), false FROM events WHERE event_type = 'view'
UNION ALL SELECT 'forecast', 'forecast_agreement', CASE WHEN abs(100.0 * (g - n) / greatest(n, 1e-6)) <= 25 THEN 'close' ELSE 'divergent' END, false FROM v
UNION ALL SELECT 'broken', NULL, NULL, true"""

QUERIES = {
    "h07_rating_for_gauges": rating_for_gauges, "h26_bank_along": bank_along, "m25_adaptive_resolution": resolutions, "m29_area_context": area_context, "m30_inside_area": inside_area, "s26_regional_catalog": regional_catalog, "s08_gauge_metadata": gauge_metadata, "s15_reach_ids": reach_ids,
    "t08_recent": recent_orders, "j18_candidate_by_id": candidate_by_id, "m18_inundation_screen": inundation_screen, "h20_rainfall_screen": rainfall_screen, "r05_live_screen": live_screen, "h27_comparison_bundle": comparison_bundle,
}
ORACLES = {
    "h07_rating_for_gauges": RATING_SQL, "h26_bank_along": BANK_SQL, "m25_adaptive_resolution": RESOLUTION_SQL, "m29_area_context": CONTEXT_SQL, "m30_inside_area": AREA_SQL, "s26_regional_catalog": CATALOG_SQL, "s08_gauge_metadata": METADATA_SQL, "s15_reach_ids": REACH_SQL,
    "t08_recent": RECENT_SQL, "j18_candidate_by_id": "SELECT '7' AS site_no, s_name AS name, 1.0::DOUBLE AS score FROM supplier WHERE s_suppkey = 7", "h27_comparison_bundle": BUNDLE_SQL,
}
