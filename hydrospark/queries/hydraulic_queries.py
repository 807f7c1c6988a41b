"""Curves, hydraulics and rainfall over the driver's tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import hydraulics as H
from hydrospark.queries.series_queries import _rounded
from hydrospark.session import table


#: Parts and line items are dealt to so many gauges.
GAUGES = 16
_BY = ["gauge"]


def _curve(spark, d):
    """Parts as the rating curves of 16 gauges: number -> price."""
    p = table(spark, d, "part")
    return H.rating_curve(p.select((F.col("p_partkey") % GAUGES).alias("gauge"), F.col("p_partkey").alias("flow_cfs"), F.col("p_retailprice").alias("stage_ft")), _BY)


def _lines(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") % GAUGES).alias("gauge"), "l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_discount") * 7).alias("q"), (895.0 + F.col("l_quantity") * 2.3).alias("h"))


def stage_from_flow(spark, d):
    """H03, H04, J15."""
    return _rounded(H.stage_from_flow(_lines(spark, d), _curve(spark, d), "q", by=_BY).select("l_orderkey", "l_linenumber", "stage_ft"), 5)


def flow_from_stage(spark, d):
    """H05, W13."""
    return _rounded(H.flow_from_stage(_lines(spark, d), _curve(spark, d), "h", by=_BY).select("l_orderkey", "l_linenumber", "flow_cfs"), 4)


_CURVE = f"WITH c AS (SELECT p_partkey % {GAUGES} AS gauge, CAST(p_partkey AS DOUBLE) AS x, min(p_retailprice) AS y FROM part GROUP BY 1, 2), "


def _lookup_sql(x: str, y: str, probe: str, out: str, places: int) -> str:
    return _CURVE + f"""u AS (SELECT gauge, {x} AS x0, min({y}) AS y0 FROM c GROUP BY 1, 2),
s AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM u WINDOW w AS (PARTITION BY gauge ORDER BY x0)),
e AS (SELECT gauge, min({x}) AS lo, max({x}) AS hi FROM c GROUP BY 1), p AS (SELECT e.gauge, l_orderkey, l_linenumber, least(greatest({probe}, lo), hi) AS q FROM lineitem JOIN e ON e.gauge = l_partkey % {GAUGES})
SELECT l_orderkey, l_linenumber, round(y0 + coalesce((y1 - y0) * (q - x0) / (x1 - x0), 0.0), {places}) AS {out} FROM p ASOF JOIN s ON p.gauge = s.gauge AND p.q >= s.x0"""


def rating_range(spark, d):
    """H06."""
    return H.rating_range(_curve(spark, d), _BY)


RANGE_SQL = f"SELECT p_partkey % {GAUGES} AS gauge, CAST(min(p_partkey) AS DOUBLE) AS min_flow_cfs, CAST(max(p_partkey) AS DOUBLE) AS max_flow_cfs, min(p_retailprice) AS min_stage_ft, max(p_retailprice) AS max_stage_ft FROM part GROUP BY 1"


def scs_kirpich(spark, d):
    """H15, H16, F23."""
    p = table(spark, d, "part")
    wet = F.element_at(F.array(F.lit("dry"), F.lit("normal"), F.lit("wet")), (F.col("p_size") % 3 + 1).cast("int"))
    return _rounded(p.select("p_partkey", X.scs_runoff_in(F.col("p_size") / 4.0, X.curve_number(wet)).alias("runoff_in"), X.kirpich_hours(F.col("p_retailprice") * 10, F.col("p_size") / 5000.0).alias("tc_hours")), 6)


SCS_SQL = """WITH p AS (SELECT p_partkey, p_size / 4.0 AS p, 1000.0 / [75.0, 85.0, 92.0][p_size % 3 + 1] - 10.0 AS s, greatest(p_retailprice * 10, 100.0) AS l, least(greatest(p_size / 5000.0, 0.0001), 0.02) AS sl FROM part)
SELECT p_partkey, round(CASE WHEN p <= 0.2 * s THEN 0.0 ELSE (p - 0.2 * s) ^ 2 / (p - 0.2 * s + s) END, 6) AS runoff_in, round(least(greatest(0.01947 * pow(l, 0.77) * pow(sl, -0.385) / 60.0, 0.25), 72.0), 6) AS tc_hours FROM p"""


def scs_hydrograph(spark, d):
    """H17."""
    s = table(spark, d, "supplier")
    q = s.select("s_suppkey", (F.abs("s_acctbal") / 1000.0).alias("rainfall_in"), (1.0 + F.col("s_nationkey")).alias("duration_hours"), (1.0 + F.col("s_suppkey") % 40).alias("basin_area_sqmi"), (60.0 + F.col("s_nationkey")).alias("curve_number"), (3000.0 + 300.0 * F.col("s_nationkey")).alias("mainstem_length_m"), F.lit(0.001).alias("mainstem_slope"), F.lit(25.0).alias("baseline_cfs"))
    out = H.scs_hydrograph(q, 30.0)
    return _rounded(out.select("s_suppkey", "time_hours", "streamflow", "peak_total_cfs", "runoff_volume_m3"), 4)


SCS_HYDRO_SQL = """WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 1000.0 AS p, 1.0 + s_nationkey AS dur, 1.0 + s_suppkey % 40 AS area, 1000.0 / (60.0 + s_nationkey) - 10.0 AS s, 3000.0 + 300.0 * s_nationkey AS l FROM supplier),
r AS (SELECT *, CASE WHEN p <= 0.2 * s THEN 0.0 ELSE (p - 0.2 * s) ^ 2 / (p + 0.8 * s) END AS q, 0.6 * least(greatest(0.01947 * pow(l, 0.77) * pow(0.001, -0.385) / 60.0, 0.25), 72.0) AS lag FROM s),
t AS (SELECT *, dur / 2.0 + lag AS tp, greatest(2.67 * (dur / 2.0 + lag), dur / 2.0 + lag + 0.25) AS tb FROM r),
u AS (SELECT *, 484.0 * area * q / tp AS qp, CAST(ceil((tb + 0.25) / 0.5) AS BIGINT) AS n FROM t),
g AS (SELECT s_suppkey, area, q, tp, tb, qp, unnest(list_transform(range(0, n), lambda k: k * 0.5) || CASE WHEN (n - 1) * 0.5 < tb THEN [tb] ELSE [] END) AS h FROM u)
SELECT s_suppkey, round(h, 4) AS time_hours, round(25.0 + CASE WHEN h <= tp THEN qp * h / tp ELSE qp * greatest(tb - h, 0.0) / (tb - tp) END, 4) AS streamflow, round(25.0 + qp, 4) AS peak_total_cfs, round(q * area * (5280.0 * 5280.0 / 12.0) * 0.028316846592, 4) AS runoff_volume_m3 FROM g"""


def volume_proxy(spark, d):
    """H21."""
    return _rounded(table(spark, d, "events").select("event_id", X.excess_volume_proxy_m3("value", 50.0, F.col("user_id") / 10.0, F.lit(0.4)).alias("volume_m3")), 3)


PROXY_SQL = "SELECT event_id, round(greatest(value - 50.0, 0.0) * 0.028316846592 * 3600.0 * (user_id / 10.0) * 0.4, 3) AS volume_m3 FROM events"


def _samples(spark, d):
    """Vectors as cross sections: place -> elevation."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("section_id"), F.posexplode("embedding").alias("p", "v")).select("section_id", F.col("p").cast("double").alias("distance_m"), (F.col("v").cast("double") * 10.0).alias("elevation_m"))


def wetted_geometry(spark, d):
    """H08, H09."""
    g = H.wetted_geometry(_samples(spark, d), ["section_id"], 0.5, left=F.lit(8.0), right=F.lit(55.0))
    return _rounded(g.withColumn("conveyance", X.conveyance("area_m2", "hydraulic_radius_m", F.lit(0.001))), 5)


WETTED_SQL = """WITH s AS (SELECT vec_id AS section_id, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) * 10.0 AS z FROM embeddings),
d AS (SELECT *, greatest(0.5 - z, 0.0) AS d FROM s WHERE x BETWEEN 8 AND 55),
g AS (SELECT *, lag(d) OVER w AS d0, z - lag(z) OVER w AS dz, (z + lag(z) OVER w) / 2 AS mid FROM d WINDOW w AS (PARTITION BY section_id ORDER BY x)),
a AS (SELECT section_id, sum((d + d0) / 2) AS area, coalesce(sum(CASE WHEN mid < 0.5 THEN sqrt(1.0 + dz * dz) END), 0.0) AS per, coalesce(max(CASE WHEN d > 0 THEN x END) - min(CASE WHEN d > 0 THEN x END), 0) AS top FROM g GROUP BY 1)
SELECT section_id, round(area, 5) AS area_m2, round(per, 5) AS wetted_perimeter_m, round(CASE WHEN area > 0 AND per > 0 THEN area / per END, 5) AS hydraulic_radius_m, round(CAST(top AS DOUBLE), 5) AS top_width_m,
  round(CASE WHEN area > 0 AND per > 0 THEN area * pow(area / per, 2.0 / 3.0) * sqrt(0.001) END, 5) AS conveyance FROM a"""


def _profile(spark, d):
    """Stations as rivers: hours along, values as conveyance (errors are missing) and freeboard."""
    from pyspark.sql import Window as W

    # A stated number of tasks, as few large ones hold more of the rivers in order at once.
    e = table(spark, d, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    s = (t - F.min(t).over(W.partitionBy("user_id"))) / 3.6e9
    p = e.select(F.col("user_id").alias("workspace_id"), F.col("event_id").alias("section_id"), s.alias("station_m"), "value", "event_type")
    area, bed = 10.0 + 60.0 / (1.0 + F.col("station_m") / 100.0), 30.0 + F.col("station_m") * 0.02
    return p.select(
        "workspace_id", "section_id", "station_m", F.when(F.col("event_type") != "error", F.col("value")).alias("bankfull_conveyance_index"), area.alias("upstream_area_km2"),
        bed.alias("routing_channel_elevation_ft_navd88"), (bed * 0.3048).alias("routing_channel_elevation_m_navd88"), (bed + 6.0 + F.col("value") / 100.0).alias("lower_bank_final_ft_navd88"),
        (F.col("value") / 10.0).alias("freeboard_raw_ft"), (F.col("event_type") != "signup").alias("raw_valid"),
    )


_PROFILE = """WITH p0 AS (SELECT user_id AS workspace_id, event_id AS section_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS station_m, value, event_type FROM events),
p AS (SELECT workspace_id, section_id, station_m, CASE WHEN event_type != 'error' THEN value END AS k, 10.0 + 60.0 / (1.0 + station_m / 100.0) AS area, 30.0 + station_m * 0.02 AS bed, 30.0 + station_m * 0.02 + 6.0 + value / 100.0 AS bank, value / 10.0 AS fb, event_type != 'signup' AS ok FROM p0)"""
_BRIDGE = """last_value({0} IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN {0} IS NOT NULL THEN station_m END IGNORE NULLS) OVER b AS s0, first_value({0} IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN {0} IS NOT NULL THEN station_m END IGNORE NULLS) OVER a AS s1"""
_BRIDGED = "CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN s1 = s0 THEN v0 ELSE v0 + (station_m - s0) / (s1 - s0) * (v1 - v0) END"
_WAYS = "WINDOW b AS (PARTITION BY workspace_id ORDER BY station_m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY workspace_id ORDER BY station_m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_MEDIAN = "median({0}) OVER (PARTITION BY workspace_id ORDER BY station_m ROWS BETWEEN {1} PRECEDING AND {1} FOLLOWING)"
QB, AG = 200.0, 70.0


def _capacity(spark, d):
    return H.robust_capacity(_profile(spark, d), QB, AG, area_exponent=0.7)


def robust_capacity(spark, d):
    """H10, H11, H12, T01."""
    return _rounded(_capacity(spark, d).select("workspace_id", "section_id", "bankfull_capacity_raw_cfs", "bankfull_capacity_geometry_smoothed_cfs", "expected_bankfull_capacity_cfs", "capacity_profile_outlier", "capacity_constrained_low", "capacity_constrained_high", "bankfull_capacity_cfs", "hydraulic_calibration_factor"), 4)


_CAP = _PROFILE + f""",
c1 AS (SELECT *, row_number() OVER w AS n, coalesce(k > 0, false) AS v, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER w AS rk FROM p WINDOW w AS (PARTITION BY workspace_id ORDER BY station_m ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT *, {QB} / coalesce(max(CASE WHEN n = 1 AND v THEN k END) OVER q, median(CASE WHEN v AND rk <= 3 THEN k END) OVER q) AS f FROM c1 WINDOW q AS (PARTITION BY workspace_id)),
c3 AS (SELECT *, k * f AS raw FROM c2),
c4 AS (SELECT *, {_MEDIAN.format('raw', 2)} AS med FROM c3),
c5 AS (SELECT *, coalesce(med > 0 AND raw > 0 AND (raw / med > 3.0 OR raw / med < 1.0 / 3.0), false) AS outl FROM c4),
c6 AS (SELECT *, sum(CASE WHEN v AND NOT outl THEN 1 ELSE 0 END) OVER q AS n1, sum(CASE WHEN v THEN 1 ELSE 0 END) OVER q AS n0 FROM c5 WINDOW q AS (PARTITION BY workspace_id)),
c7 AS (SELECT *, CASE WHEN CASE WHEN n1 >= 2 THEN v AND NOT outl ELSE v END THEN raw END AS u FROM c6),
c8 AS (SELECT *, {_BRIDGE.format('u')} FROM c7 {_WAYS}),
c9 AS (SELECT *, {_BRIDGED} AS line FROM c8),
c10 AS (SELECT *, CASE WHEN n1 < 2 AND n0 < 2 THEN raw ELSE {_MEDIAN.format('line', 1)} END AS geo, {QB} * pow(least(greatest(area / {AG}, 0.0), 1.5), 0.7) AS e FROM c9),
c11 AS (SELECT *, CASE WHEN e > 0 AND NOT coalesce(geo > 0, false) THEN e ELSE geo END AS st FROM c10),
cap AS (SELECT *, coalesce(e > 0 AND st < e, false) AS lo, coalesce(e > 0 AND st > e * 1.5, false) AS hi FROM c11),
capacity AS (SELECT workspace_id, section_id, station_m, area, bed, bank, n, raw, geo, CASE WHEN n = 1 THEN {QB} ELSE e END AS e, outl, lo, hi, CASE WHEN n = 1 THEN {QB} WHEN lo THEN e WHEN hi THEN e * 1.5 ELSE st END AS c, f FROM cap)
"""
CAPACITY_SQL = _CAP + "SELECT workspace_id, section_id, round(raw, 4) AS bankfull_capacity_raw_cfs, round(geo, 4) AS bankfull_capacity_geometry_smoothed_cfs, round(e, 4) AS expected_bankfull_capacity_cfs, outl AS capacity_profile_outlier, lo AS capacity_constrained_low, hi AS capacity_constrained_high, round(c, 4) AS bankfull_capacity_cfs, round(f, 4) AS hydraulic_calibration_factor FROM capacity"


def capacity_counts(spark, d):
    """A20."""
    return H.capacity_counts(_capacity(spark, d))


COUNTS_SQL = _CAP + "SELECT workspace_id, count(*) AS sections, CAST(sum(outl::INT) AS BIGINT) AS n_capacity_profile_outlier, CAST(sum(lo::INT) AS BIGINT) AS n_capacity_constrained_low, CAST(sum(hi::INT) AS BIGINT) AS n_capacity_constrained_high FROM capacity GROUP BY 1"

QG, STAGE, BANK, BED = 420.0, 39.5, 37.0, 30.0


def _levels(spark, d):
    return H.section_levels(_capacity(spark, d), QG, STAGE, QB, BANK, BED, AG)


def section_levels(spark, d):
    """H13, H14."""
    return _rounded(_levels(spark, d).select("workspace_id", "section_id", "local_flow_cfs", "flow_to_capacity_ratio", "scenario_wse_ft_navd88", "scenario_wse_m_navd88", "local_overtop_ft", "overtopped"), 4)


_LEVEL = _CAP + f""",
l1 AS (SELECT *, {QG} * pow(least(greatest(area / {AG}, 0.0), 1.5), 0.85) AS q FROM capacity),
l2 AS (SELECT *, CASE WHEN c > 0 THEN q / c ELSE 0.0 END AS r FROM l1),
l3 AS (SELECT *, CASE WHEN r <= 1.0 THEN 0.0 ELSE least(greatest({STAGE - BANK} * pow(greatest(r / {QG / QB}, 0.0), 0.7), 0.0), {min(12.0, (STAGE - BANK) * 1.5)}) END AS o FROM l2),
lev AS (SELECT workspace_id, section_id, station_m, bank, CASE WHEN n = 1 THEN {QG} ELSE q END AS q, CASE WHEN n = 1 THEN {QG / QB} ELSE r END AS r,
  CASE WHEN n = 1 THEN {STAGE} WHEN r <= 1.0 THEN bed + pow(least(greatest(r, 0.0), 1.0), 0.6) * greatest(bank - bed, 0.0) ELSE bank + o END AS w, CASE WHEN n = 1 THEN {STAGE - BANK} ELSE o END AS o FROM l3)
"""
LEVEL_SQL = _LEVEL + "SELECT workspace_id, section_id, round(q, 4) AS local_flow_cfs, round(r, 4) AS flow_to_capacity_ratio, round(w, 4) AS scenario_wse_ft_navd88, round(w * 0.3048, 4) AS scenario_wse_m_navd88, round(o, 4) AS local_overtop_ft, o > 0 AS overtopped FROM lev"


def stage_controls(spark, d):
    """Three controls on every third river, one on every third."""
    from pyspark.sql import functions as G

    at = G.array(*[G.struct(G.lit(s).alias("station_m"), G.lit(h).alias("stage_ft_navd88")) for s, h in ((100.0, 41.0), (300.0, 44.5), (600.0, 52.0))])
    c = table(spark, d, "events").select(F.col("user_id").alias("workspace_id")).distinct().where("workspace_id % 3 < 2")
    c = c.select("workspace_id", F.inline(F.when(F.col("workspace_id") % 3 == 0, at).otherwise(F.slice(at, 1, 1))))
    out = H.stage_controls(_levels(spark, d), c)
    return _rounded(out.select("workspace_id", "section_id", "stage_control_correction_ft", "scenario_wse_ft_navd88", "local_overtop_ft", "overtopped"), 4)


CONTROL_SQL = _LEVEL + """,
ctl AS (SELECT DISTINCT user_id AS workspace_id, s, h FROM events, (VALUES (100.0, 41.0), (300.0, 44.5), (600.0, 52.0)) t(s, h) WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND s = 100.0)),
seg AS (SELECT workspace_id, station_m AS x0, w AS y0, lead(station_m) OVER q AS x1, lead(w) OVER q AS y1, min(station_m) OVER (PARTITION BY workspace_id) AS lo, max(station_m) OVER (PARTITION BY workspace_id) AS hi FROM lev WINDOW q AS (PARTITION BY workspace_id ORDER BY station_m)),
ends AS (SELECT DISTINCT workspace_id, lo, hi FROM seg),
prob AS (SELECT ctl.*, least(greatest(s, lo), hi) AS x FROM ctl JOIN ends USING (workspace_id)),
res AS (SELECT p.workspace_id, p.s, h - (y0 + coalesce((y1 - y0) * (x - x0) / (x1 - x0), 0.0)) AS res FROM prob p ASOF JOIN seg ON p.workspace_id = seg.workspace_id AND p.x >= seg.x0),
rseg AS (SELECT workspace_id, s AS x0, res AS y0, lead(s) OVER q AS x1, lead(res) OVER q AS y1 FROM res WINDOW q AS (PARTITION BY workspace_id ORDER BY s)),
rends AS (SELECT workspace_id, min(s) AS lo, max(s) AS hi FROM res GROUP BY 1),
asked AS (SELECT lev.*, least(greatest(station_m, lo), hi) AS x FROM lev LEFT JOIN rends USING (workspace_id)),
fixed AS (SELECT asked.*, y0 + coalesce((y1 - y0) * (x - x0) / (x1 - x0), 0.0) AS corr FROM asked ASOF LEFT JOIN rseg ON asked.workspace_id = rseg.workspace_id AND asked.x >= rseg.x0)
SELECT workspace_id, section_id, round(corr, 4) AS stage_control_correction_ft, round(w + coalesce(corr, 0.0), 4) AS scenario_wse_ft_navd88, round(CASE WHEN corr IS NULL THEN o ELSE greatest(w + corr - bank, 0.0) END, 4) AS local_overtop_ft, CASE WHEN corr IS NULL THEN o > 0 ELSE greatest(w + corr - bank, 0.0) > 0 END AS overtopped FROM fixed"""


def largest_correction(spark, d):
    """Of one control at 300 on every river."""
    c = table(spark, d, "events").select(F.col("user_id").alias("workspace_id")).distinct().select("workspace_id", F.lit(300.0).alias("station_m"), F.lit(44.5).alias("stage_ft_navd88"))
    return _rounded(H.largest_correction(H.stage_controls(_levels(spark, d), c)), 4)


LARGEST_SQL = _LEVEL + """,
seg AS (SELECT workspace_id, station_m AS x0, w AS y0, lead(station_m) OVER q AS x1, lead(w) OVER q AS y1, min(station_m) OVER (PARTITION BY workspace_id) AS lo, max(station_m) OVER (PARTITION BY workspace_id) AS hi FROM lev WINDOW q AS (PARTITION BY workspace_id ORDER BY station_m)),
prob AS (SELECT DISTINCT workspace_id, least(greatest(300.0, lo), hi) AS x FROM seg)
SELECT p.workspace_id, round(abs(44.5 - (y0 + coalesce((y1 - y0) * (x - x0) / (x1 - x0), 0.0))), 4) AS max_abs_stage_control_correction_ft FROM prob p ASOF JOIN seg ON p.workspace_id = seg.workspace_id AND p.x >= seg.x0"""


def finalize_freeboard(spark, d):
    """H23, W04, W12."""
    out = H.finalize_freeboard(_profile(spark, d).drop("lower_bank_final_ft_navd88"))
    return _rounded(out.select("workspace_id", "section_id", "profile_outlier", "profile_used_raw", "freeboard_final_ft", "lower_bank_final_ft_navd88"), 4)


FREEBOARD_SQL = _PROFILE + f""",
f1 AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY station_m) AS n, {_MEDIAN.format('fb', 2)} AS med FROM p),
f2 AS (SELECT *, abs(fb - med) > 4.0 AND NOT (n = 1 AND ok) AS outl FROM f1),
f3 AS (SELECT *, sum(CASE WHEN ok AND NOT outl THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id) AS m FROM f2),
f4 AS (SELECT *, CASE WHEN m >= 2 THEN ok AND NOT outl ELSE true END AS used FROM f3),
f5 AS (SELECT *, CASE WHEN used THEN fb END AS u FROM f4), f6 AS (SELECT *, {_BRIDGE.format('u')} FROM f5 {_WAYS}), f7 AS (SELECT *, {_BRIDGED} AS line FROM f6),
f8 AS (SELECT *, coalesce(lag(line) OVER w, line) AS a1, coalesce(lead(line) OVER w, line) AS a3 FROM f7 WINDOW w AS (PARTITION BY workspace_id ORDER BY station_m)),
f9 AS (SELECT *, CASE WHEN n = 1 AND ok THEN fb ELSE a1 + line + a3 - greatest(a1, line, a3) - least(a1, line, a3) END AS fin FROM f8)
SELECT workspace_id, section_id, outl AS profile_outlier, used AS profile_used_raw, round(fin, 4) AS freeboard_final_ft, round(bed + fin, 4) AS lower_bank_final_ft_navd88 FROM f9"""


def profile_geometry(spark, d):
    """H19, A02."""
    return _rounded(H.profile_geometry(_profile(spark, d)), 7)


GEOMETRY_SQL = _PROFILE + "SELECT workspace_id, round(max(station_m), 7) AS length_m, round(least(greatest(CASE WHEN count(*) >= 2 AND max(station_m) > 0 THEN abs(arg_max(bed, station_m) - arg_min(bed, station_m)) / greatest(max(station_m) * 3.280839895, 1.0) ELSE 0.0005 END, 0.0001), 0.02), 7) AS slope FROM p GROUP BY 1"


def channel_slope(spark, d):
    """H24, W08."""
    return _rounded(H.channel_slope(_profile(spark, d)).select("workspace_id", "section_id", "local_channel_slope"), 7)


SLOPE_SQL = _PROFILE + f""", m AS (SELECT *, {_MEDIAN.format('bed * 0.3048', 2)} AS z FROM p),
g AS (SELECT *, lag(z) OVER w AS f0, lead(z) OVER w AS f2, station_m - lag(station_m) OVER w AS h1, lead(station_m) OVER w - station_m AS h2 FROM m WINDOW w AS (PARTITION BY workspace_id ORDER BY station_m))
SELECT workspace_id, section_id, round(least(greatest(abs(CASE WHEN h1 IS NULL THEN (f2 - z) / h2 WHEN h2 IS NULL THEN (z - f0) / h1 ELSE -h2 / (h1 * (h1 + h2)) * f0 + (h2 - h1) / (h1 * h2) * z + h1 / (h2 * (h1 + h2)) * f2 END), 0.00001), 0.02), 7) AS local_channel_slope FROM g"""


def absolute_rating(spark, d):
    """Parts as gage tables; only heights on NAVD88 are taken."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 2.0).alias("gage_height_ft"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("alt"), F.element_at(F.array(F.lit("NAVD88"), F.lit("NGVD29"), F.lit("local"), F.lit("North American (navd) of 1988")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("datum"))
    p = p.withColumn("c", X.datum_candidate("alt", "datum"))
    return _rounded(H.absolute_rating(p.withColumn("v", F.col("c.value")), "v").select("p_partkey", F.col("c.status").alias("status"), "stage_ft"), 4)


ABSOLUTE_SQL = """WITH p AS (SELECT p_partkey, p_size / 2.0 AS g, CASE WHEN p_size % 7 != 0 THEN p_retailprice END AS alt, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN alt IS NULL THEN 'missing_gage_datum' WHEN k IN (0, 3) THEN 'provisional_navd88_metadata' WHEN k = 1 THEN 'ngvd29_requires_conversion_or_manual_override' ELSE 'vertical_datum_not_navd88' END AS status, round(CASE WHEN k IN (0, 3) THEN g + alt END, 4) AS stage_ft FROM p"""


def peak_difference(spark, d):
    """The peaks of two types of event at each station."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("g"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("n"))
    return _rounded(e.withColumn("c", X.peak_difference("g", "n")).select("user_id", F.col("c.percent").alias("percent"), F.col("c.agreement").alias("agreement")), 5)


DIFFERENCE_SQL = """WITH e AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS g, max(value) FILTER (event_type = 'click') AS n FROM events GROUP BY 1), p AS (SELECT user_id, CASE WHEN greatest(g, n) > 0 THEN 100.0 * (g - n) / greatest(n, 1e-6) END AS pct FROM e)
SELECT user_id, round(pct, 5) AS percent, CASE WHEN pct IS NULL THEN NULL WHEN abs(pct) <= 25 THEN 'close' ELSE 'divergent' END AS agreement FROM p"""

QUERIES = {
    "h04_stage_from_flow": stage_from_flow, "h05_flow_from_stage": flow_from_stage, "h06_rating_range": rating_range, "h15_scs_kirpich": scs_kirpich, "h17_scs_hydrograph": scs_hydrograph, "h21_volume_proxy": volume_proxy, "h08_wetted_geometry": wetted_geometry,
    "h12_robust_capacity": robust_capacity, "a20_capacity_counts": capacity_counts, "h13_section_levels": section_levels, "j17_stage_controls": stage_controls, "a21_largest_correction": largest_correction, "h23_finalize_freeboard": finalize_freeboard,
    "h19_profile_geometry": profile_geometry, "h24_channel_slope": channel_slope, "x20_absolute_rating": absolute_rating, "x23_peak_difference": peak_difference,
}
ORACLES = {
    "h04_stage_from_flow": _lookup_sql("x", "y", "l_partkey + l_discount * 7", "stage_ft", 5), "h05_flow_from_stage": _lookup_sql("y", "x", "895.0 + l_quantity * 2.3", "flow_cfs", 4), "h06_rating_range": RANGE_SQL, "h15_scs_kirpich": SCS_SQL, "h17_scs_hydrograph": SCS_HYDRO_SQL, "h21_volume_proxy": PROXY_SQL, "h08_wetted_geometry": WETTED_SQL,
    "h12_robust_capacity": CAPACITY_SQL, "a20_capacity_counts": COUNTS_SQL, "h13_section_levels": LEVEL_SQL, "j17_stage_controls": CONTROL_SQL, "a21_largest_correction": LARGEST_SQL, "h23_finalize_freeboard": FREEBOARD_SQL,
    "h19_profile_geometry": GEOMETRY_SQL, "h24_channel_slope": SLOPE_SQL, "x20_absolute_rating": ABSOLUTE_SQL, "x23_peak_difference": DIFFERENCE_SQL,
}
