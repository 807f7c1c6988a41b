"""Names, tiles, candidates and places over the driver's tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import matching as M
from hydrospark.queries.series_queries import _rounded
from hydrospark.session import table


def slugs(spark, d):
    """F01."""
    return table(spark, d, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" // "), "p_brand", F.lit("!"))).alias("slug"))


SLUG_SQL = "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim(p_name || ' // ' || p_brand || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug FROM part"

def _text():
    return F.concat_ws(" ", "p_name", F.element_at(F.array(F.lit("Creek near"), F.lit("River at Houston TX"), F.lit("bayou, above St."), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")))


_TEXT_SQL = "(p_name || CASE p_partkey % 4 WHEN 0 THEN ' Creek near' WHEN 1 THEN ' River at Houston TX' WHEN 2 THEN ' bayou, above St.' ELSE ' ' END)"
_STOP = "['at','near','nr','above','below','houston','tx','texas','street','st','road','rd','drive','dr']"


def _toks(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(replace(replace(lower({x}), 'creek', 'ck'), 'river', 'rv'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w != '' AND NOT list_contains({_STOP}, w))"


def waterway_names(spark, d):
    """F02, F06."""
    return table(spark, d, "part").select("p_partkey", X.waterway_name(_text()).alias("name"), F.size(X.long_tokens(_text())).cast("long").alias("n_long"))


WATERWAY_SQL = f"SELECT p_partkey, array_to_string({_toks(_TEXT_SQL)}, ' ') AS name, CAST(len(list_filter(string_split(trim(regexp_replace(lower({_TEXT_SQL}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) > 2)) AS BIGINT) AS n_long FROM part"


def same_waterway(spark, d):
    """Every part's name against that of the part before it."""
    p = table(spark, d, "part").select("p_partkey", _text().alias("n"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("n").alias("m"))
    return p.join(q, "p_partkey").select("p_partkey", X.same_waterway("n", "m").alias("same"))


SAME_SQL = f"""WITH t AS (SELECT p_partkey AS k, list_distinct({_toks(_TEXT_SQL)}) AS s, array_to_string({_toks(_TEXT_SQL)}, ' ') AS n FROM part)
SELECT a.k AS p_partkey, a.n != '' AND b.n != '' AND (contains(b.n, a.n) OR contains(a.n, b.n) OR len(list_intersect(a.s, b.s)) >= greatest(1, least(2, len(a.s)))) AS same FROM t a JOIN t b ON a.k = b.k + 1"""


def match_tiles(spark, d):
    """Suppliers as wanted names of parts' tiles, in all three tiers."""
    tiles = table(spark, d, "part").select(F.concat(F.lit("dem/"), "p_partkey").alias("key"), F.concat(F.lit("Tile_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("_Final.tif")).alias("name"))
    n = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    wanted = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("a/b/tile_"), n, F.lit("_final"))).when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit("TILE-"), n)).when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit("usgs_tile_"), n, F.lit("_draft_x"))).when(F.col("s_suppkey") % 5 == 3, F.lit("tile")).otherwise(F.lit("000000")).alias("tile_name"),
        F.lit("none").alias("other"),
    )
    return M.match_tiles(wanted.select("id", X.named_values("other", "tile_name").alias("values")), tiles).select("id", "tile")


TILE_SQL = """WITH t AS (SELECT 'dem/' || p_partkey AS key, lower('Tile_' || lpad(p_partkey::VARCHAR, 6, '0') || '_Final.tif') AS name, 'tile' || lpad(p_partkey::VARCHAR, 6, '0') AS bare FROM part),
w AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'tile_' || lpad(s_suppkey::VARCHAR, 6, '0') || '_final' WHEN 1 THEN 'tile-' || lpad(s_suppkey::VARCHAR, 6, '0') WHEN 2 THEN 'usgs_tile_' || lpad(s_suppkey::VARCHAR, 6, '0') || '_draft_x' WHEN 3 THEN 'tile' ELSE '000000' END AS base FROM supplier),
b AS (SELECT id, base, regexp_replace(regexp_replace(base, 'preliminary|final|draft', '', 'g'), '[^a-z0-9]+', '', 'g') AS bare FROM w),
t1 AS (SELECT id, min(key) AS tile FROM b JOIN t ON t.name IN (base, base || '.tif', base || '.tiff') GROUP BY 1),
t2 AS (SELECT id, min(key) AS tile FROM b JOIN t USING (bare) WHERE len(bare) >= 5 GROUP BY 1 HAVING count(*) = 1),
t3 AS (SELECT id, min(key) AS tile FROM b JOIN t ON contains(t.bare, b.bare) OR contains(b.bare, t.bare) WHERE len(b.bare) >= 6 GROUP BY 1 HAVING count(DISTINCT key) = 1)
SELECT b.id, coalesce(t1.tile, t2.tile, t3.tile) AS tile FROM b LEFT JOIN t1 USING (id) LEFT JOIN t2 USING (id) LEFT JOIN t3 USING (id)"""


def _candidates(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("n_name", F.col("s_suppkey").cast("string").alias("site_no"), F.concat_ws(" ", F.lit("Buffalo"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("Bayou")).otherwise(F.lit("Creek")), F.lit("at"), "n_name").alias("name"), (F.col("s_acctbal") + 1000).alias("distance_to_click_m"), (F.col("s_suppkey") % 2 == 0).alias("basin_contains_click"), (F.col("s_suppkey") % 7 != 0).alias("recent_data_ok"))


def rank_gauges(spark, d):
    """H28, T02, T03."""
    return _rounded(M.rank_gauges(_candidates(spark, d), "Buffalo Bayou").select("site_no", "same_waterway_name", "auto_supported", "score"), 3)


_RANK = """WITH c AS (SELECT n_name, s_suppkey::VARCHAR AS site_no, 'buffalo ' || CASE WHEN s_suppkey % 3 = 0 THEN 'bayou' ELSE 'ck' END AS nm, s_acctbal + 1000 AS dist, s_suppkey % 2 = 0 AS b, s_suppkey % 7 != 0 AS r, s_suppkey % 3 = 0 AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT *, CASE WHEN b THEN 0 ELSE 1000000 END + CASE WHEN r THEN 0 ELSE 250000 END + CASE WHEN s THEN 0 ELSE 5000000 END + dist AS score FROM c)
"""


def best_supported(spark, d):
    """In each nation."""
    return _rounded(M.best_supported(M.rank_gauges(_candidates(spark, d), "Buffalo Bayou"), ["n_name"]).select("n_name", "site_no", "score"), 3)


def _places(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (29.0 + (F.col("c_custkey") * 37 % 1000) / 1000.0).alias("lat"), (-96.0 + (F.col("c_custkey") * 91 % 1000) / 1000.0).alias("lon"))
    s = table(spark, d, "supplier").select("s_suppkey", (29.0 + (F.col("s_suppkey") * 53 % 1000) / 1000.0).alias("flat"), (-96.0 + (F.col("s_suppkey") * 17 % 1000) / 1000.0).alias("flon"))
    return c, s


_PLACE = """WITH c AS (SELECT c_custkey, 29.0 + (c_custkey * 37 % 1000) / 1000.0 AS lat, -96.0 + (c_custkey * 91 % 1000) / 1000.0 AS lon FROM customer),
s AS (SELECT s_suppkey, 29.0 + (s_suppkey * 53 % 1000) / 1000.0 AS flat, -96.0 + (s_suppkey * 17 % 1000) / 1000.0 AS flon FROM supplier),
p AS (SELECT c_custkey, s_suppkey, 2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(flat - lat) / 2) ^ 2 + cos(radians(lat)) * cos(radians(flat)) * sin(radians(flon - lon) / 2) ^ 2))) AS km FROM c, s)
"""


def nearest(spark, d):
    """The nearest supplier of every customer within 60 km."""
    c, s = _places(spark, d)
    out = M.nearest(c, s, "c_custkey", X.haversine_km("lat", "lon", "flat", "flon"), "s_suppkey", limit=60.0)
    return _rounded(out.select("c_custkey", "s_suppkey", F.col("distance").alias("km")), 5)


def nearest_three(spark, d):
    """The three nearest."""
    c, s = _places(spark, d)
    out = M.nearest(c, s, "c_custkey", X.haversine_km("lat", "lon", "flat", "flon"), "s_suppkey", n=3)
    return _rounded(out.select("c_custkey", "s_suppkey", F.col("rank").cast("long").alias("rank"), F.col("distance").alias("km")), 5)


def nearest_or_else(spark, d):
    """The nearest within 4 km of one third of the suppliers, else within 60 km of all."""
    c, s = _places(spark, d)
    km = X.haversine_km("lat", "lon", "flat", "flon")
    a = M.nearest(c, s.where("s_suppkey % 3 = 0"), "c_custkey", km, "s_suppkey", limit=4.0)
    b = M.nearest(c, s, "c_custkey", km, "s_suppkey", limit=60.0)
    return _rounded(M.nearest_or_else(c, a, b, "c_custkey").select("c_custkey", "s_suppkey", "source", F.col("distance").alias("km")), 5)


def flat_distance(spark, d):
    """flat distance to a point, inside its box of 40 km."""
    c, _ = _places(spark, d)
    box = X.degree_box(F.lit(29.5), F.lit(-95.5), F.lit(40.0))
    inside = c.where(F.col("lat").between(box["south"], box["north"]) & F.col("lon").between(box["west"], box["east"]))
    return _rounded(inside.select("c_custkey", X.flat_km("lat", "lon", F.lit(29.5), F.lit(-95.5)).alias("km")), 6)


FLAT_SQL = _PLACE + "SELECT c_custkey, round(sqrt(((lat - 29.5) * 111.32) ^ 2 + ((lon + 95.5) * 111.32 * cos(radians(29.5))) ^ 2), 6) AS km FROM c WHERE lat BETWEEN 29.5 - 40 / 111.32 AND 29.5 + 40 / 111.32 AND lon BETWEEN -95.5 - 40 / (111.32 * cos(radians(29.5))) AND -95.5 + 40 / (111.32 * cos(radians(29.5)))"


def utm_round_trip(spark, d):
    """F16: there and back to a micro-degree; the grid's northing grows with latitude."""
    c, _ = _places(spark, d)
    u = c.withColumn("u", X.to_utm("lon", "lat")).withColumn("b", X.from_utm("u.x", "u.y"))
    return u.select("c_custkey", F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"), (F.col("u.y") > 3_000_000).alias("north"))


UTM_SQL = _PLACE + "SELECT c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS north FROM c"


def name_then_distance(spark, d):
    """T06."""
    c = _candidates(spark, d).withColumn("distance", F.when(F.col("site_no").cast("int") % 4 != 0, F.col("distance_to_click_m")))
    return _rounded(M.name_then_distance(c, F.lit("the bayou"), ["name"], ["n_name"], "site_no").select("n_name", "site_no", "name_match", "distance"), 3)


NAME_SQL = _RANK + "SELECT n_name, site_no, s AS name_match, round(coalesce(CASE WHEN site_no::INT % 4 != 0 THEN dist END, 1e9), 3) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY NOT s, coalesce(CASE WHEN site_no::INT % 4 != 0 THEN dist END, 1e9), site_no) = 1"


def widening(spark, d):
    """Gauges under 3000 m; nations without one take those under 8000 m."""
    c = _candidates(spark, d).select("n_name", "site_no", "distance_to_click_m")
    return M.widening(c.where("distance_to_click_m < 3000"), c.where("distance_to_click_m < 8000"), ["n_name"]).select("n_name", "site_no")


WIDEN_SQL = _RANK + "SELECT n_name, site_no FROM k WHERE dist < 3000 OR (dist < 8000 AND n_name NOT IN (SELECT n_name FROM k WHERE dist < 3000))"


def range_tiles(spark, d):
    """Boxes of customers that touch boxes of suppliers."""
    c, s = _places(spark, d)
    a = c.select("c_custkey", F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 0.02).alias("x1"), (F.col("lat") + 0.01).alias("y1"))
    b = s.select("s_suppkey", F.col("flon").alias("tx0"), F.col("flat").alias("ty0"), (F.col("flon") + 0.05).alias("tx1"), (F.col("flat") + 0.05).alias("ty1"))
    return M.range_tiles(a, b, 0.1).select("c_custkey", "s_suppkey")


RANGE_SQL = _PLACE + "SELECT c_custkey, s_suppkey FROM c, s WHERE lon <= flon + 0.05 AND flon <= lon + 0.02 AND lat <= flat + 0.05 AND flat <= lat + 0.01"


def iso_durations(spark, d):
    """F07, F08."""
    q = F.col("l_quantity").cast("int")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("P"), q, F.lit("DT1H"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("PT"), q, F.lit("M"))).when(F.col("l_linenumber") == 3, F.concat(F.lit("PT2H"), q, F.lit(".5S"))).otherwise(F.concat(F.lit("bad"), q))
    v = X.valid_time(F.concat(F.lit("2024-01-02T03:00:00Z/"), text))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.iso_seconds(text).alias("seconds"), (v["seconds"] / 3600.0).alias("hours"), v["start"].isNotNull().alias("has_start")).withColumn("hours", F.round("hours", 6))


ISO_SQL = """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity * 86400 + 3600 WHEN 2 THEN l_quantity * 60 WHEN 3 THEN 7200 + l_quantity + 0.5 ELSE 0.0 END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(s AS DOUBLE) AS seconds, round(s / 3600.0, 6) AS hours, true AS has_start FROM s"""


def section_flags(spark, d):
    """X13, X14."""
    l = table(spark, d, "lineitem")
    f = X.section_flags(F.col("l_quantity") - 25, F.col("l_quantity") * 2 - 80, F.col("l_tax") * 1000, "l_quantity", F.col("l_discount") * 100, F.col("l_quantity") - 10)
    return l.select("l_orderkey", "l_linenumber", F.array_join(f, ";").alias("qa_flags"), (F.size(f) == 0).alias("raw_valid"), F.array_join(F.array_sort(F.array_distinct(f)), ";").alias("sorted_flags"))


_F = ["CASE WHEN abs(q - 25) > 15 THEN 'channel_low_far_from_mainstem_center' END", "CASE WHEN abs(q * 2 - 80 - (q - 25)) > 70 THEN 'left_bank_far_from_channel' END", "CASE WHEN abs(l_tax * 1000 - (q - 25)) > 70 THEN 'right_bank_far_from_channel' END", "CASE WHEN abs(q - l_discount * 100) > 8 THEN 'bank_elevation_asymmetry_gt_8ft' END", "CASE WHEN q - 10 < 4 THEN 'lower_bank_relief_lt_4ft' END", "CASE WHEN q - 10 > 30 THEN 'lower_bank_relief_gt_30ft' END"]
FLAG_SQL = f"""WITH f AS (SELECT l_orderkey, l_linenumber, list_filter([{', '.join(_F)}], lambda x: x IS NOT NULL) AS f FROM (SELECT *, l_quantity AS q FROM lineitem) l)
SELECT l_orderkey, l_linenumber, coalesce(array_to_string(f, ';'), '') AS qa_flags, len(f) = 0 AS raw_valid, coalesce(array_to_string(list_sort(f), ';'), '') AS sorted_flags FROM f"""


def aoi_status(spark, d):
    """X15."""
    o = table(spark, d, "orders")
    inside, cover, over, touch, dist = F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0 + 0.02, F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 50) / 50.0), F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 4).cast("double")
    return o.select("o_orderkey", F.array_join(X.aoi_warnings(inside, cover, over, touch, dist), ";").alias("warnings"), X.aoi_status(inside, cover, over).alias("status"))


AOI_SQL = """WITH a AS (SELECT o_orderkey, o_orderkey % 5 != 0 AS i, (o_orderkey % 100) / 100.0 + 0.02 AS c, CASE WHEN o_custkey % 3 != 0 THEN (o_custkey % 50) / 50.0 END AS b, o_custkey % 2 = 0 AS t, o_custkey % 4 AS g FROM orders)
SELECT o_orderkey, coalesce(array_to_string(list_filter([CASE WHEN NOT i THEN 'gauge_outside_dem_model_domain' END, CASE WHEN c < 0.999 THEN 'aoi_not_fully_covered_by_dem' END, CASE WHEN b < 0.5 THEN 'aoi_has_less_than_50pct_overlap_with_gauge_upstream_basin' END, CASE WHEN NOT t THEN 'aoi_does_not_intersect_current_mainstem' END, CASE WHEN g > 0 THEN 'gauge_outside_display_aoi_but_can_be_used_if_same_hydraulic_network' END], lambda x: x IS NOT NULL), ';'), '') AS warnings,
CASE WHEN NOT i OR c < 0.95 THEN 'model_domain_needs_expansion' WHEN b < 0.1 THEN 'current_gauge_basin_probably_not_applicable' ELSE 'supported' END AS status FROM a"""


def gauge_pages(spark, d):
    """Readings written as pages of JSON and read back."""
    from hydrospark.sources import payloads as P

    e = table(spark, d, "events")
    prop = F.struct(F.col("event_type").alias("parameter_code"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.when(F.col("event_id") % 11 != 0, F.col("value").cast("string")).alias("value"), F.lit("ft3/s").alias("unit_of_measure"))
    pages = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct(prop.alias("properties"))).alias("features"))).alias("payload"))
    r = P.gauge_readings(P.first_with_rows(pages.where("user_id < 0"), pages), keys=["user_id"])
    return r.groupBy("user_id", "parameter").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("unit").alias("unit"))


PAGE_SQL = "SELECT user_id, event_type AS parameter, count(*) AS n, round(sum(value), 4) AS total, 'ft3/s' AS unit FROM events WHERE event_id % 11 != 0 GROUP BY 1, 2"


def legacy_pages(spark, d):
    """S03."""
    from hydrospark.sources import payloads as P

    e = table(spark, d, "events")
    v = e.groupBy("user_id", "event_type").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("dateTime"), F.when(F.col("event_id") % 13 == 0, F.lit("Ice")).otherwise(F.col("value").cast("string")).alias("value"))).alias("value"))
    s = F.struct(F.struct(F.array(F.struct(F.col("event_type").alias("value"))).alias("variableCode")).alias("variable"), F.array(F.struct("value")).alias("values"))
    pages = v.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(s).alias("timeSeries")).alias("value"))).alias("payload"))
    return P.legacy_readings(pages, keys=["user_id"]).groupBy("user_id", "parameter").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


LEGACY_SQL = "SELECT user_id, event_type AS parameter, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 13 != 0 GROUP BY 1, 2"


def nested_streamflow(spark, d):
    """Records of any nesting, under any of the known keys."""
    from hydrospark.sources import payloads as P

    e = table(spark, d, "events")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(t.alias("validTime"), F.col("value").alias("streamflow")))).otherwise(F.to_json(F.struct(t.alias("time"), F.struct(F.lit(1).alias("x")).alias("meta"), F.col("value").cast("string").alias("value"))))
    pages = e.groupBy("user_id").agg(F.concat(F.lit('{"series": {"data": [['), F.array_join(F.collect_list(rec), ","), F.lit("]]}}")).alias("payload"))
    return P.streamflow(pages, keys=["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("streamflow"), 4).alias("total"))


NESTED_SQL = "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS t, value FROM events) GROUP BY 1"


def forecast_flatten(spark, d):
    """Forecasts of two issues as maps by gauge; the newest issue stays."""
    from hydrospark.operators import series as S
    from hydrospark.sources import payloads as P

    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'")
    f = e.groupBy("user_id", day.alias("day")).agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("forecastStartTime"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("forecastEndTime"), "value")).alias("forecastRanges"))
    g = f.groupBy("user_id").agg(F.struct(F.collect_list(F.struct(F.col("day").alias("issuedTime"), "forecastRanges")).alias("forecasts")).alias("s"))
    pages = g.select("user_id", F.to_json(F.struct(F.create_map(F.concat(F.lit("g"), "user_id"), "s").alias("forecasts"))).alias("payload"))
    r = S.newest_issue(P.forecasts(pages, keys=["user_id"], unit="CUBIC_METERS_PER_SECOND"), ["gauge_id"])
    return r.groupBy("gauge_id").agg(F.count("*").alias("n"), F.round(F.max("value_cfs"), 4).alias("peak_cfs"))


FORECAST_SQL = "WITH e AS (SELECT 'g' || user_id AS gauge_id, value, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS newest FROM events) SELECT gauge_id, count(*) AS n, round(max(value) * 35.3146667215, 4) AS peak_cfs FROM e WHERE day = newest GROUP BY 1"


def rain_forecast(spark, d):
    """S10, F08."""
    from hydrospark.sources import payloads as P

    e = table(spark, d, "events")
    v = F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("/PT"), (F.col("event_id") % 12 + 1), F.lit("H")).alias("validTime"), "value")
    pages = e.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(v).alias("values")).alias("quantitativePrecipitation")).alias("properties"))).alias("payload"))
    return P.rainfall_forecast(pages, keys=["user_id"]).groupBy("user_id").agg(F.round(F.sum("precip_in"), 5).alias("rain_in"), F.sum("duration_hours").alias("hours"))


RAINFALL_SQL = "SELECT user_id, round(sum(value / 25.4), 5) AS rain_in, CAST(sum(event_id % 12 + 1) AS DOUBLE) AS hours FROM events GROUP BY 1"


def rating_files(spark, d):
    """Parts as tab-separated rating tables by brand, with comments, header and a row of types."""
    from hydrospark.sources import payloads as P

    p = table(spark, d, "part")
    data = p.select("p_brand", (F.col("p_partkey") + 10).alias("n"), F.concat_ws("\t", F.col("p_size").cast("string"), F.lit("0.1"), F.col("p_retailprice").cast("string")).alias("line"))
    head = p.select("p_brand").distinct().select("p_brand", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("n"), F.lit(s).alias("line")) for k, s in enumerate(("# comment\tINDEP", "INDEP\tSHIFT\tDEP", "16N\t16N\t16N"))])))
    return P.rating_table(data.unionByName(head), keys=["p_brand"], number="n")


RATING_SQL = "SELECT p_brand, CAST(p_size AS DOUBLE) AS gage_height_ft, 0.1 AS shift_ft, min(p_retailprice) AS flow_cfs FROM part GROUP BY 1, 2"


def kml_rings(spark, d):
    """S13."""
    from hydrospark.sources import payloads as P

    s = table(spark, d, "supplier")
    x, y = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")
    k = F.concat(F.lit("<kml xmlns='http://x'><Polygon><coordinates> "), x, F.lit(",1,0 "), y, F.lit(",1,0 "), y, F.lit(",2 "), x, F.lit(",2\n</coordinates></Polygon><Point><coordinates>1,2</coordinates></Point></kml>"))
    r = P.kml_rings(s.select("s_suppkey", k.alias("kml")), keys=["s_suppkey"])
    return r.select("s_suppkey", F.size("ring").cast("long").alias("points"), F.element_at("ring", -1)["x"].alias("last_x"), F.element_at("ring", 2)["x"].alias("second_x"))


KML_SQL = "SELECT s_suppkey, CAST(5 AS BIGINT) AS points, CAST(s_suppkey AS DOUBLE) AS last_x, CAST(s_suppkey + 1 AS DOUBLE) AS second_x FROM supplier"


def json_props(spark, d):
    """F09, X21."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), X.json_safe(F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("v"))


JSON_SQL = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 9 != 0 THEN value END AS v FROM events"

QUERIES = {
    "f01_slugify": slugs, "f02_waterway_names": waterway_names, "j13_same_waterway": same_waterway, "j12_match_tiles": match_tiles, "h28_rank_gauges": rank_gauges, "t04_best_supported": best_supported, "j04_nearest": nearest, "t07_nearest_three": nearest_three, "j06_nearest_or_else": nearest_or_else,
    "f14_flat_distance": flat_distance, "f16_utm_round_trip": utm_round_trip, "t06_name_then_distance": name_then_distance, "t05_widening": widening, "j02_range_tiles": range_tiles, "f07_iso_durations": iso_durations, "x13_section_flags": section_flags, "x15_aoi_status": aoi_status,
    "s02_gauge_pages": gauge_pages, "s03_legacy_pages": legacy_pages, "s06_nested_streamflow": nested_streamflow, "s12_forecast_flatten": forecast_flatten, "s10_rain_forecast": rain_forecast, "s09_rating_files": rating_files, "s13_kml_rings": kml_rings, "f09_json_props": json_props,
}
ORACLES = {
    "f01_slugify": SLUG_SQL, "f02_waterway_names": WATERWAY_SQL, "j13_same_waterway": SAME_SQL, "j12_match_tiles": TILE_SQL, "h28_rank_gauges": _RANK + "SELECT site_no, s AS same_waterway_name, b AND r AND s AS auto_supported, round(score, 3) AS score FROM k", "t04_best_supported": _RANK + "SELECT n_name, site_no, round(score, 3) AS score FROM k WHERE b AND r AND s QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY score, site_no) = 1",
    "j04_nearest": _PLACE + "SELECT c_custkey, s_suppkey, round(km, 5) AS km FROM p WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1", "t07_nearest_three": _PLACE + "SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank, round(km, 5) AS km FROM p QUALIFY rank <= 3",
    "j06_nearest_or_else": _PLACE + ", a AS (SELECT c_custkey, s_suppkey, km FROM p WHERE km <= 4 AND s_suppkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1), b AS (SELECT c_custkey, s_suppkey, km FROM p WHERE km <= 60 AND c_custkey NOT IN (SELECT c_custkey FROM a) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1) SELECT c_custkey, s_suppkey, 'primary' AS source, round(km, 5) AS km FROM a UNION ALL SELECT c_custkey, s_suppkey, 'secondary', round(km, 5) FROM b",
    "f14_flat_distance": FLAT_SQL, "f16_utm_round_trip": UTM_SQL, "t06_name_then_distance": NAME_SQL, "t05_widening": WIDEN_SQL, "j02_range_tiles": RANGE_SQL, "f07_iso_durations": ISO_SQL, "x13_section_flags": FLAG_SQL, "x15_aoi_status": AOI_SQL,
    "s02_gauge_pages": PAGE_SQL, "s03_legacy_pages": LEGACY_SQL, "s06_nested_streamflow": NESTED_SQL, "s12_forecast_flatten": FORECAST_SQL, "s10_rain_forecast": RAINFALL_SQL, "s09_rating_files": RATING_SQL, "s13_kml_rings": KML_SQL, "f09_json_props": JSON_SQL,
}
