"""Raster and graph operators over ``embeddings`` as a grid of 64 columns, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import distance as D
from hydrospark.operators import graph as G
from hydrospark.operators import raster as R
from hydrospark.queries.series_queries import _rounded
from hydrospark.session import table

NCOLS = 64
GRID = (2.0, 0.0, 1000.0, 0.0, -2.0, 5000.0)


def _cells(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))


_C = "WITH RECURSIVE cells AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_OFF = "(VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) o(k, dr, dc)"
_D8 = _C + f""",
drops AS (SELECT a.row, a.col, a.value, k, dr, dc, (a.value - b.value) / sqrt(dr * dr + dc * dc) AS dz FROM cells a, {_OFF} JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc),
best AS (SELECT row, col, arg_max({{'k': k, 'dr': dr, 'dc': dc, 'dz': dz}}, {{'dz': dz, 'k': -k}}) AS b FROM drops GROUP BY 1, 2),
d8 AS (SELECT c.row, c.col, c.value, CAST(CASE WHEN b.dz > 0 THEN b.k ELSE -1 END AS INTEGER) AS direction, CASE WHEN b.dz > 0 THEN c.row + b.dr END AS ds_row, CASE WHEN b.dz > 0 THEN c.col + b.dc END AS ds_col FROM cells c JOIN best USING (row, col)),
ptr AS (SELECT row * {NCOLS} + col AS id, ds_row * {NCOLS} + ds_col AS ptr, value FROM d8),
walk AS (SELECT id, id AS cur, 0 AS steps FROM ptr UNION ALL SELECT walk.id, ptr.ptr, steps + 1 FROM walk JOIN ptr ON walk.cur = ptr.id WHERE ptr.ptr IS NOT NULL),
area AS (SELECT cur AS id, CAST(count(*) AS DOUBLE) AS total FROM walk GROUP BY 1)
"""


def _d8(spark, d):
    return R.flow_direction(_cells(spark, d))


def flow_direction(spark, d):
    """M01, M02, J14."""
    return _d8(spark, d).select("row", "col", "direction")


def _pointers(spark, d):
    return G.checkpointed(R.pointers(_d8(spark, d), NCOLS))


def upstream_area(spark, d):
    """M03, M04."""
    return G.accumulate(_pointers(spark, d))


def pit_of_cell(spark, d):
    """Where every cell drains to, and over how many steps."""
    return G.follow(_pointers(spark, d))


def basin(spark, d):
    """Basins of the cells that take in eight cells or more."""
    p = _pointers(spark, d)
    return G.basin(p, G.accumulate(p).where("total >= 8"))


_BASIN = _D8 + ", met AS (SELECT walk.id, arg_min(cur, steps) AS outlet FROM walk JOIN area ON area.id = cur WHERE total >= 8 GROUP BY 1)"


def height_above_drain(spark, d):
    """M11, X19."""
    p = _pointers(spark, d)
    z = _cells(spark, d).select(R.cell_id(NCOLS), F.col("value").alias("z"))
    return _rounded(G.height_above_drain(p, z, G.accumulate(p).where("total >= 8")), 7)


HAND_SQL = _BASIN + """, h AS (SELECT met.id, outlet, b.value AS dz, a.value - b.value AS h FROM met JOIN ptr a ON a.id = met.id JOIN ptr b ON b.id = outlet)
SELECT id, outlet AS drain, round(dz, 7) AS drain_elevation, round(CASE WHEN h < 0 AND h > -0.01 THEN 0.0 ELSE h END, 7) AS hand FROM h"""


def mainstem(spark, d):
    """Main upstream paths from every pit, while two cells or more flow in."""
    p = _pointers(spark, d)
    return G.mainstem(p, G.accumulate(p), p.where("ptr is null"), 2.0)


MAIN_SQL = _D8 + """, up AS (SELECT ptr AS id, arg_max(p.id, {'t': total, 'i': -p.id}) AS up FROM ptr p JOIN area USING (id) WHERE ptr IS NOT NULL GROUP BY 1),
ms AS (SELECT id, 0 AS path_index FROM ptr WHERE ptr IS NULL UNION ALL SELECT up.up, path_index + 1 FROM ms JOIN up USING (id) JOIN area ON area.id = up.up WHERE total >= 2)
SELECT id, CAST(path_index AS BIGINT) AS path_index FROM ms"""


def trace_down(spark, d):
    """The way down from every source, a cell that no cell drains to."""
    p = _pointers(spark, d)
    fed = p.where("ptr is not null").select(F.col("ptr").alias("id")).distinct()
    return G.trace_down(p, p.select("id").join(fed, "id", "left_anti"))


TRACE_SQL = _D8 + "SELECT walk.id AS start, cur AS id, CAST(steps AS BIGINT) AS steps FROM walk JOIN ptr s ON s.id = walk.id WHERE s.id NOT IN (SELECT ptr FROM ptr WHERE ptr IS NOT NULL)"


#: Cells of a fifth of a thousandth of a degree, and a UTM grid of 25 m.
DEGREES = (0.0002, 0.0, -95.6, 0.0, -0.0002, 30.0)
METRES = (25.0, 0.0, 200_000.0, 0.0, -25.0, 3_400_000.0)


def reproject(spark, d):
    """The grid in degrees on a grid in metres."""

    def to_utm(lon, lat):
        u = X.to_utm(lon, lat)
        return u["x"], u["y"]

    def from_utm(x, y):
        u = X.from_utm(x, y)
        return u["lon"], u["lat"]

    return _rounded(R.reproject(_cells(spark, d), DEGREES, METRES, to_utm, from_utm), 7)


def _utm_sql():
    """SQL macros of the series, term by term."""
    n, k = X._N, X._K0 * X._R
    c = 2 * n**0.5 / (1 + n)
    north = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(X._ALPHA, 1)])
    east = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(X._ALPHA, 1)])
    xi1 = " - ".join(["p"] + [f"{b!r} * sin({2 * j} * p) * cosh({2 * j} * q)" for j, b in enumerate(X._BETA, 1)])
    eta1 = " - ".join(["q"] + [f"{b!r} * cos({2 * j} * p) * sinh({2 * j} * q)" for j, b in enumerate(X._BETA, 1)])
    phi = " + ".join(["chi"] + [f"{v!r} * sin({2 * j} * chi)" for j, v in enumerate(X._DELTA, 1)])
    return f""",
f0 AS (SELECT sin(radians(30.0 - 0.0002 * row)) AS s, radians(-95.6 + 0.0002 * col + 93) AS lam FROM (SELECT row + a AS row, col + b AS col FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b))),
f1 AS (SELECT sinh(atanh(s) - {c!r} * atanh({c!r} * s)) AS t, lam FROM f0),
f2 AS (SELECT atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM f1),
f3 AS (SELECT floor((500000 + {k!r} * ({east}) - 200000) / 25) AS col, floor((3400000 - {k!r} * ({north})) / 25) AS row FROM f2),
e AS (SELECT CAST(min(row) AS BIGINT) - 2 AS r0, CAST(max(row) AS BIGINT) + 2 AS r1, CAST(min(col) AS BIGINT) - 2 AS c0, CAST(max(col) AS BIGINT) + 2 AS c1 FROM f3),
t AS (SELECT row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT unnest(range(r0, r1 + 1)) AS row, c0, c1 FROM e)),
i0 AS (SELECT row, col, (3400000 - (row + 0.5::DOUBLE) * 25) / {k!r} AS p, (200000 + (col + 0.5::DOUBLE) * 25 - 500000) / {k!r} AS q FROM t),
i1 AS (SELECT row, col, {xi1} AS xi, {eta1} AS eta FROM i0),
i2 AS (SELECT row, col, asin(sin(xi) / cosh(eta)) AS chi, degrees(atan2(sinh(eta), cos(xi))) - 93 AS lon FROM i1),
i3 AS (SELECT row, col, floor((30.0 - degrees({phi})) / 0.0002) AS sr, floor((lon + 95.6) / 0.0002) AS sc FROM i2)
SELECT CAST(i3.row AS INTEGER) AS row, CAST(i3.col AS INTEGER) AS col, round(value, 7) AS value FROM i3 JOIN cells ON cells.row = sr AND cells.col = sc"""


REPROJECT_SQL = _C + _utm_sql()


def distance_to_mask(spark, d):
    """How far every cell is from the nearest cell over 0.3, with no cut-off."""
    c = _cells(spark, d)
    return _rounded(D.distance_to_mask(c, c.where("value > 0.3"), GRID).select("row", "col", "distance_m"), 6)


DISTANCE_SQL = _C + """, m AS (SELECT row, col FROM cells WHERE value > 0.3)
SELECT c.row, c.col, round(sqrt(min((c.row - m.row) ** 2 + (c.col - m.col) ** 2)) * 2.0, 6) AS distance_m FROM cells c, m GROUP BY 1, 2"""


def components(spark, d):
    """8-connected groups of three cells or more over 0.12 that hold a cell over 0.3."""
    m = _cells(spark, d).where("value > 0.12")
    seeds = m.where("value > 0.3").select(R.cell_id(NCOLS))
    return G.seeded(G.checkpointed(R.labels(m, NCOLS)), seeds, 3)


COMPONENT_SQL = _C + f""", m AS (SELECT row, col, row * {NCOLS} + col AS id, value FROM cells WHERE value > 0.12),
l AS (SELECT a.id AS a, b.id AS b FROM m a, {_OFF} JOIN m b ON b.row = a.row + dr AND b.col = a.col + dc),
r AS (SELECT id, id AS o FROM m UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.o),
lab AS (SELECT id, min(o) AS root FROM r GROUP BY 1),
k AS (SELECT root FROM lab JOIN m USING (id) GROUP BY 1 HAVING count(*) >= 3 AND max(value) > 0.3)
SELECT CAST(id AS BIGINT) AS id, CAST(root AS BIGINT) AS root FROM lab JOIN k USING (root)"""


def zonal(spark, d):
    """Wet cells of every label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), "label")
    return _rounded(R.zonal(_cells(spark, d).join(e, "row"), ["label"], grid=GRID, least=0.05), 6)


ZONAL_SQL = """WITH c AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, count(*) AS pixels, round(count(*) * 4.0, 6) AS area_m2, round(count(*) * 4.0 / 2589988.110336, 6) AS area_sqmi, round(sum(v * 4.0), 6) AS volume_m3, round(max(v), 6) AS max_value, round(avg(v), 6) AS mean_value,
round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM c WHERE v >= 0.05 GROUP BY 1"""


def argmax_cell(spark, d):
    """T09, M20."""
    return R.argmax_cell(_cells(spark, d))


ARGMAX_SQL = _C + " SELECT row, col, value FROM cells ORDER BY value DESC, row, col LIMIT 1"


def _coded(spark, d):
    both = R.overlay(_cells(spark, d), R.coarsen(_cells(spark, d), 1).withColumnRenamed("value", "other").select((F.col("row") + 1).alias("row"), "col", "other"))
    return R.confusion(both, F.col("value") >= 0.05, F.col("other") >= 0.05)


def confusion(spark, d):
    """Each row's wet cells against those of the row before."""
    return _coded(spark, d).select("row", "col", F.col("code").cast("int").alias("code"))


CONFUSION = _C + ", k AS (SELECT a.row, a.col, CASE WHEN a.value >= 0.05 AND b.value >= 0.05 THEN 1 WHEN a.value >= 0.05 THEN 2 WHEN b.value >= 0.05 THEN 3 ELSE 0 END AS code FROM cells a JOIN cells b ON b.row + 1 = a.row AND b.col = a.col)"


def extent_scores(spark, d):
    """A11, M31."""
    return _rounded(R.extent_scores(_coded(spark, d), GRID), 8)


SCORES_SQL = CONFUSION + """, n AS (SELECT count(*) FILTER (code = 1) AS tp, count(*) FILTER (code = 2) AS fp, count(*) FILTER (code = 3) AS fn, count(*) FILTER (code = 0) AS tn FROM k), s AS (SELECT *, tp / (tp + fp + 1e-12) AS p, tp / (tp + fn + 1e-12) AS r FROM n)
SELECT tp, fp, fn, tn, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r + 1e-12), 8) AS f1, round(tp / (tp + fp + fn + 1e-12), 8) AS csi, round(tn / (tn + fp + 1e-12), 8) AS specificity, round((tp + fp) * 4.0, 8) AS model_area_m2, round((tp + fn) * 4.0, 8) AS reference_area_m2, round((tp + fp) / (tp + fn), 8) AS area_bias_ratio FROM s"""


def coarsen(spark, d):
    """M26, M23."""
    return _rounded(R.coarsen(_cells(spark, d), 4), 7)


COARSEN_SQL = _C + " SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(avg(value), 7) AS value FROM cells GROUP BY 1, 2"


def _target(spark, d):
    return _cells(spark, d).where("row % 3 = 0 and col % 3 = 0").select((F.col("row") / 3).cast("int").alias("row"), (F.col("col") / 3).cast("int").alias("col"))


COARSE = (5.0, 0.0, 1001.0, 0.0, -5.0, 4999.5)


def resample_nearest(spark, d):
    """M23."""
    return R.resample(_target(spark, d), _cells(spark, d), COARSE, GRID)


_T = ", t AS (SELECT row // 3 AS row, col // 3 AS col, ((1001.0 + (col // 3 + 0.5) * 5.0) - 1000.0) / 2.0 AS u, (5000.0 - (4999.5 - (row // 3 + 0.5) * 5.0)) / 2.0 AS v FROM cells WHERE row % 3 = 0 AND col % 3 = 0)"
NEAREST_SQL = _C + _T + " SELECT CAST(t.row AS INTEGER) AS row, CAST(t.col AS INTEGER) AS col, value FROM t LEFT JOIN cells c ON c.row = floor(v) AND c.col = floor(u)"


def resample_bilinear(spark, d):
    """M23."""
    return _rounded(R.resample(_target(spark, d), _cells(spark, d), COARSE, GRID, method="bilinear"), 6)


BILINEAR_SQL = _C + _T + """, q AS (SELECT t.row, t.col, floor(v - 0.5) + i AS r, floor(u - 0.5) + j AS c, (CASE WHEN i = 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END) * (CASE WHEN j = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT CAST(q.row AS INTEGER) AS row, CAST(q.col AS INTEGER) AS col, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM q LEFT JOIN cells k ON k.row = q.r AND k.col = q.c WHERE w > 0 GROUP BY 1, 2"""


def _sections(spark, d):
    c = _cells(spark, d).where("row % 25 = 7 and col % 16 = 5")
    xy = X.cell_center("row", "col", GRID)
    return c.select((F.col("row") * 100 + F.col("col")).alias("section_id"), xy["x"].alias("x"), xy["y"].alias("y"), (F.col("value") * 10 + 3).alias("wse"))


def nearest_section(spark, d):
    """J07, M19."""
    return _rounded(R.nearest_section(_cells(spark, d), _sections(spark, d), GRID, 20.0).select("row", "col", "section_id", "wse", "distance_m"), 6)


SECTION_SQL = _C + """, s AS (SELECT row AS r, col AS c, row * 100 + col AS section_id, value * 10 + 3 AS wse FROM cells WHERE row % 25 = 7 AND col % 16 = 5),
n AS (SELECT cells.row, cells.col, arg_min({'i': section_id, 'w': wse, 'd': (row - r) ^ 2 * 4.0 + (col - c) ^ 2 * 4.0}, {'d': (row - r) ^ 2 * 4.0 + (col - c) ^ 2 * 4.0, 'r': r, 'c': c}) AS b FROM cells JOIN s ON (row - r) ^ 2 * 4.0 + (col - c) ^ 2 * 4.0 <= 400.0 GROUP BY 1, 2)
SELECT cells.row, cells.col, b.i AS section_id, round(b.w, 6) AS wse, round(sqrt(b.d), 6) AS distance_m FROM cells LEFT JOIN n USING (row, col)"""


def wet_cells(spark, d):
    """Under a water level, not in the channel, within reach of a section."""
    c = _cells(spark, d)
    channel = c.where("col between 30 and 33")
    near = R.nearest_section(c, _sections(spark, d), GRID, 20.0)
    wet = near.where((F.col("wse") - 3.0 - F.col("value") >= 0.05) & F.col("value").between(-0.2, 0.2))
    return _rounded(R.masked(wet, drop=[channel]).select("row", "col", (F.col("wse") - 3.0 - F.col("value")).alias("depth")), 6)


WET_SQL = SECTION_SQL.replace("SELECT cells.row, cells.col, b.i AS section_id, round(b.w, 6) AS wse, round(sqrt(b.d), 6) AS distance_m FROM cells LEFT JOIN n USING (row, col)", "SELECT cells.row, cells.col, round(b.w - 3.0 - value, 6) AS depth FROM cells JOIN n USING (row, col) WHERE b.w - 3.0 - value >= 0.05 AND value BETWEEN -0.2 AND 0.2 AND col NOT BETWEEN 30 AND 33")


def sample(spark, d):
    """Customers as points."""
    p = table(spark, d, "customer").select("c_custkey", (1000.0 + F.col("c_custkey") % 131).alias("x"), (5000.5 - F.col("c_custkey") % 1009).alias("y"))
    return _rounded(R.sample(p, _cells(spark, d), "x", "y", GRID).select("c_custkey", "sampled"), 7)


SAMPLE_SQL = _C + " SELECT c_custkey, round(value, 7) AS sampled FROM customer LEFT JOIN cells ON row = floor((5000.0 - (5000.5 - c_custkey % 1009)) / 2.0) AND col = floor((c_custkey % 131) / 2.0)"


def mosaic(spark, d):
    """Three overlapping tiles, the first wins."""
    c = _cells(spark, d)
    tiles = c.where("col < 30").withColumn("tile", F.lit(1)).unionByName(c.where("col between 20 and 50").withColumns({"tile": F.lit(2), "value": F.col("value") + 1})).unionByName(c.where("col > 40").withColumns({"tile": F.lit(3), "value": F.col("value") + 2}))
    return _rounded(R.mosaic(tiles, "tile"), 7)


MOSAIC_SQL = _C + " SELECT row, col, round(CASE WHEN col < 30 THEN value WHEN col <= 50 THEN value + 1 ELSE value + 2 END, 7) AS value FROM cells"


def depth_colours(spark, d):
    """M24, F21."""
    return R.depth_colours(_cells(spark, d)).select("row", "col", "red", "green", "blue", "alpha")


def _ramp(k: int) -> str:
    from hydrospark.functions.constants import DEPTH_RAMP

    out = f"{float(DEPTH_RAMP[-1][k])}"
    for a, b in reversed(list(zip(DEPTH_RAMP, DEPTH_RAMP[1:]))):
        out = f"CASE WHEN s < {b[0]} THEN {float(a[k])} + {float(b[k] - a[k])} * (s - {a[0]}) / {b[0] - a[0]} ELSE {out} END"
    return f"CAST(floor(CASE WHEN s <= 0 THEN {float(DEPTH_RAMP[0][k])} ELSE {out} END) AS INTEGER)"


COLOUR_SQL = _C + f""", t AS (SELECT greatest(quantile_cont(value, 0.98), 0.25) AS top FROM cells WHERE value > 0.02), s AS (SELECT row, col, value, least(greatest(value / top, 0.0), 1.0) AS s FROM cells, t)
SELECT row, col, {_ramp(1)} AS red, {_ramp(2)} AS green, {_ramp(3)} AS blue, CASE WHEN value > 0.02 THEN 185 ELSE 0 END AS alpha FROM s"""


def extent_edges(spark, d):
    """M13 (sides): the border of the cells over 0.12."""
    return R.extent_edges(_cells(spark, d).where("value > 0.12"))


EDGE_SQL = _C + """, m AS (SELECT row, col FROM cells WHERE value > 0.12)
SELECT row AS r0, col AS c0, row + 1 AS r1, col AS c1 FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.row = m.row AND n.col = m.col - 1)
UNION ALL SELECT row + 1, col, row + 1, col + 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.row = m.row + 1 AND n.col = m.col)
UNION ALL SELECT row + 1, col + 1, row, col + 1 FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.row = m.row AND n.col = m.col + 1)
UNION ALL SELECT row, col + 1, row, col FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.row = m.row - 1 AND n.col = m.col)"""


def running_fill(spark, d):
    """W14, M17 (fill): cells in the order of a cost take a budget of 900 m3."""
    c = _cells(spark, d).withColumns({"cost": F.col("row") + F.col("col") * 0.37, "depth": F.col("value")})
    return _rounded(R.running_fill(c, 900.0, "cost", "depth", GRID).select("row", "col", "filled_depth"), 6)


FILL_SQL = _C + """, c AS (SELECT row, col, value, sum(value * 4.0) OVER (ORDER BY row + col * 0.37, row, col) AS cum FROM cells WHERE value > 0)
SELECT row, col, round(CASE WHEN cum <= 900.0 THEN value ELSE (900.0 - (cum - value * 4.0)) / 4.0 END, 6) AS filled_depth FROM c WHERE cum <= 900.0 OR cum - value * 4.0 < 900.0"""

POLYGON = [(1010.0, 4990.0), (1100.0, 4900.0), (1060.0, 4600.0), (1020.0, 4700.0), (1010.0, 4990.0)]


def clip_polygon(spark, d):
    """Cells with their centre in a polygon."""
    ring = F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POLYGON]))
    rings = table(spark, d, "region").where("r_regionkey = 0").select(ring.alias("rings"))
    return R.clip_to_rings(_cells(spark, d), rings, GRID).select("row", "col")


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(POLYGON, POLYGON[1:]))
CLIP_SQL = _C + f""", p AS (SELECT row, col, 1000.0 + (col + 0.5) * 2.0 AS x, 5000.0 - (row + 0.5) * 2.0 AS y FROM cells), e AS (SELECT * FROM (VALUES {_EDGES}) t(ax, ay, bx, b_y)),
k AS (SELECT row, col, count(*) FILTER ((ay > y) != (b_y > y) AND x < ax + (y - ay) * (bx - ax) / nullif(b_y - ay, 0)) % 2 = 1 OR bool_or((bx - ax) * (y - ay) - (b_y - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, b_y) AND greatest(ay, b_y)) AS inside FROM p, e GROUP BY 1, 2)
SELECT row, col FROM k WHERE inside"""

QUERIES = {
    "m01_flow_direction": flow_direction, "m02_pit_of_cell": pit_of_cell, "m03_upstream_area": upstream_area, "m06_basin": basin, "m07_mainstem": mainstem, "m08_trace_down": trace_down, "m11_height_above_drain": height_above_drain, "m16_components": components,
    "a01_zonal": zonal, "t09_argmax_cell": argmax_cell, "a11_confusion": confusion, "m31_extent_scores": extent_scores, "m26_coarsen": coarsen, "m23_resample_nearest": resample_nearest, "m23_resample_bilinear": resample_bilinear, "j07_nearest_section": nearest_section,
    "m19_distance_to_mask": distance_to_mask, "m23_reproject": reproject, "x12_wet_cells": wet_cells, "j11_sample": sample, "u02_mosaic": mosaic, "m24_depth_colours": depth_colours, "m13_extent_edges": extent_edges, "w14_running_fill": running_fill, "m21_clip_polygon": clip_polygon,
}
ORACLES = {
    "m01_flow_direction": _D8 + "SELECT row, col, direction FROM d8", "m02_pit_of_cell": _D8 + "SELECT id, arg_max(cur, steps) AS root, CAST(max(steps) AS BIGINT) AS steps FROM walk GROUP BY 1", "m03_upstream_area": _D8 + "SELECT id, total FROM area", "m06_basin": _BASIN + " SELECT id, outlet FROM met", "m07_mainstem": MAIN_SQL, "m08_trace_down": TRACE_SQL, "m11_height_above_drain": HAND_SQL, "m16_components": COMPONENT_SQL,
    "a01_zonal": ZONAL_SQL, "t09_argmax_cell": ARGMAX_SQL, "a11_confusion": CONFUSION + " SELECT row, col, code FROM k", "m31_extent_scores": SCORES_SQL, "m26_coarsen": COARSEN_SQL, "m23_resample_nearest": NEAREST_SQL, "m23_resample_bilinear": BILINEAR_SQL, "j07_nearest_section": SECTION_SQL,
    "m19_distance_to_mask": DISTANCE_SQL, "m23_reproject": REPROJECT_SQL, "x12_wet_cells": WET_SQL, "j11_sample": SAMPLE_SQL, "u02_mosaic": MOSAIC_SQL, "m24_depth_colours": COLOUR_SQL, "m13_extent_edges": EDGE_SQL, "w14_running_fill": FILL_SQL, "m21_clip_polygon": CLIP_SQL,
}
