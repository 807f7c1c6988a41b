"""Whole-grid and shape operators over ``embeddings`` as a terrain.

Those without SQL beside them are path problems, held against plain restatements in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydrospark.operators import banks as B
from hydrospark.operators import geometry as G
from hydrospark.operators import graph as Gr
from hydrospark.operators import overlay as O
from hydrospark.operators import raster as R
from hydrospark.operators import simplify as Si
from hydrospark.operators import terrain as T
from hydrospark.plans import validation as V
from hydrospark.queries.raster_queries import _C, GRID, NCOLS, _cells
from hydrospark.queries.series_queries import _rounded
from hydrospark.session import table
from hydrospark.sources import tiff


def fill_depressions(spark, d):
    """M01, M12."""
    return _rounded(T.fill_depressions(_cells(spark, d)), 7)


def cost_distance(spark, d):
    """The way from the first column, uphill steps cost more."""
    c = _cells(spark, d)
    return _rounded(T.cost_distance(c, c.where("col = 0"), grid=GRID), 6)


def volume_limited_fill(spark, d):
    """Cells under a level of 0.1, filled from the deepest cell of every 50 rows with 400 m3."""
    c = _cells(spark, d).withColumnRenamed("value", "ground").withColumn("depth", 0.1 - F.col("ground")).where("depth > 0.02")
    seeds = R.argmax_cell(c.withColumn("band", F.floor(F.col("row") / 50)), "depth", ["band"])
    return _rounded(T.volume_limited_fill(c, seeds, 400.0, grid=GRID).select("row", "col", "cost", "filled_depth"), 6)


def outlines(spark, d):
    """Outlines of the connected cells over 0.2, ring by ring, with their areas."""
    m = _cells(spark, d).where("value > 0.2")
    parts = Gr.checkpointed(R.labels(m, NCOLS, 4))
    named = parts.select("root", F.floor(F.col("id") / NCOLS).cast("int").alias("row"), (F.col("id") % NCOLS).cast("int").alias("col"))
    return G.ring_table(named, GRID, ["root"]).groupBy("root").agg(F.sum("n_points").alias("corners"), F.round(F.sum("area"), 4).alias("area_m2"))


OUTLINE_SQL = _C + f""", m AS (SELECT row, col, row * {NCOLS} + col AS id FROM cells WHERE value > 0.2),
l AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
r AS (SELECT id, id AS o FROM m UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.o),
lab AS (SELECT id, min(o) AS root FROM r GROUP BY 1),
a AS (SELECT root, count(*) AS n FROM lab GROUP BY 1),
-- A corner for every bend of the border: where one or three of the four cells around a place are in, and two for two that touch there.
spots AS (SELECT root, id // {NCOLS} + dr AS r, id % {NCOLS} + dc AS c, dr + 2 * dc AS k FROM lab, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)),
around AS (SELECT root, r, c, count(*) AS n, sum(k) AS s FROM spots GROUP BY 1, 2, 3),
corners AS (SELECT root, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) AS corners FROM around GROUP BY 1)
SELECT CAST(root AS BIGINT) AS root, CAST(corners AS BIGINT) AS corners, round(a.n * 4.0, 4) AS area_m2 FROM a JOIN corners USING (root)"""


def _sections(spark, d):
    """Every row as a section across the grid."""
    e = table(spark, d, "embeddings")
    w = (8.0 + F.col("label")).alias("w")
    base = e.select(F.lit(0).alias("workspace_id"), F.col("vec_id").alias("section_id"), (F.col("vec_id") * 2.0).alias("station_m"), w)
    return base.select("workspace_id", "section_id", "station_m", F.lit(1064.0).alias("center_x"), (4999.0 - F.col("station_m")).alias("center_y"), F.lit(1.0).alias("cross_dx"), F.lit(0.0).alias("cross_dy"), F.when(F.col("section_id") % 40 != 14, -F.col("w")).alias("left_bank_distance_m"), F.col("w").alias("right_bank_distance_m"))


def corridor(spark, d):
    """Cells that the corridor between the banks touches, with 2 m to spare."""
    n = table(spark, d, "embeddings").count()
    return G.cells_near_rings(G.corridor_quads(_sections(spark, d)), GRID, n, NCOLS, 2.0)


def find_banks(spark, d):
    """Banks on every row."""
    keys = ["workspace_id", "section_id"]
    tall = _cells(spark, d).withColumn("value", F.col("value") * 10 + F.abs(F.col("col") - 32) * 0.1)
    samples = B.smoothed(B.sample_lines(_sections(spark, d), tall, GRID, keys, 60.0, 2.0), keys)
    return _rounded(B.find_banks(samples, keys, spacing=2.0), 5)


def validate_marks(spark, d):
    """Customers as high-water marks in feet against the grid as levels."""
    c = table(spark, d, "customer").select("c_custkey", (1000.5 + F.col("c_custkey") % 127).alias("x"), (4999.5 - F.col("c_custkey") % 999).alias("y"), (F.col("c_acctbal") / 10000.0).alias("wse_ft"))
    return _rounded(V.validate_marks(c, _cells(spark, d), GRID, "x", "y", "wse_ft")[1], 6)


MARK_SQL = _C + """, p AS (SELECT value - c_acctbal / 10000.0 * 0.3048 AS e FROM customer LEFT JOIN cells ON row = floor((5000.0 - (4999.5 - c_custkey % 999)) / 2.0) AND col = floor((0.5 + c_custkey % 127) / 2.0))
SELECT count(*) AS point_count, count(e) AS valid_comparison_count, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM p"""


def bounds(spark, d):
    """The box of all cells over 0.3, each a part of one shape."""
    m = _cells(spark, d).where("value > 0.3")
    x, y = 1000.0 + F.col("col") * 2.0, 5000.0 - F.col("row") * 2.0
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, -2.0), (0.0, -2.0), (0.0, 0.0))])
    return G.bounds(m.select(F.array(ring).alias("rings")))


BOUND_SQL = _C + " SELECT min(1000.0 + col * 2.0) AS min_x, min(5000.0 - row * 2.0 - 2.0) AS min_y, max(1002.0 + col * 2.0) AS max_x, max(5000.0 - row * 2.0) AS max_y FROM cells WHERE value > 0.3"



def raster_files(spark, d):
    """The grid written as TIFF files of 512 cells squared, and read back from all of their blocks."""
    folder = f"{Gr.shared_folder(spark).rstrip('/')}/rasters-{uuid.uuid4().hex}"
    tiff.write(_cells(spark, d), folder, GRID, side=512)
    return _rounded(tiff.read(tiff.index(spark, folder), GRID).select("row", "col", "value"), 6)


def mask_window(spark, d):
    """The cells over 0.2 as mask files, and those of them that lie in the blocks that a box in map units meets."""
    folder = f"{Gr.shared_folder(spark).rstrip('/')}/masks-{uuid.uuid4().hex}"
    tiff.write(_cells(spark, d).where("value > 0.2"), folder, GRID, mask=True, side=64, block=16)
    return tiff.read(tiff.in_window(tiff.index(spark, folder), 1040.0, -1e9, 1090.0, 5000.0), GRID).select("row", "col")


# The box reaches over all rows from column 20 to 45, in blocks of 16 columns that is from 16 to 47.
WINDOW_SQL = _C + " SELECT row, col FROM cells WHERE value > 0.2 AND col BETWEEN 16 AND 47"



def _box_rings(*boxes):
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return F.array(*[ring(*map(F.expr, b)) for b in boxes]).alias("rings")


#: Customers as plots with a hole, suppliers as strips; corners are whole numbers, so SQL can count unit cells.
_PLOT = ("2 * (c_custkey // 10)", "c_custkey * 37 % 300", "2 * (c_custkey // 10) + 6 + c_custkey % 5", "c_custkey * 37 % 300 + 5 + c_custkey % 7")
_HOLE = ("2 * (c_custkey // 10) + 2", "c_custkey * 37 % 300 + 1", "2 * (c_custkey // 10) + 4", "c_custkey * 37 % 300 + 3")
_STRIP = ("3 * s_suppkey", "s_suppkey * 53 % 300", "3 * s_suppkey + 10 + s_suppkey % 6", "s_suppkey * 53 % 300 + 40")


def _plots(spark, d):
    spark_div = lambda b: [e.replace("c_custkey // 10", "c_custkey div 10") for e in b]
    plots = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), _box_rings(spark_div(_PLOT), spark_div(_HOLE)))
    return plots, table(spark, d, "supplier").select(_box_rings(_STRIP))


def overlay(spark, d):
    """Each nation's plots dissolved, and what of them lies in the union of all strips."""
    plots, strips = _plots(spark, d)
    return _rounded(O.overlay_areas(plots, strips, ["nation"], 50.0), 4)


def union_area(spark, d):
    """Areas of the union of all plots, of all strips, and of what they share."""
    return _rounded(O.overlay_areas(*_plots(spark, d), (), 50.0), 4)


def _unit_cells(name, table_, keys, box, hole=None):
    out = f" AND NOT (x >= {hole[0]} AND x < {hole[2]} AND y >= {hole[1]} AND y < {hole[3]})" if hole else ""
    return f"{name} AS (SELECT DISTINCT {keys} x, y FROM (SELECT *, unnest(range({box[0]}, {box[2]})) AS x FROM {table_}), LATERAL (SELECT unnest(range({box[1]}, {box[3]})) AS y) WHERE true{out})"


_UNITS = "WITH " + _unit_cells("p", "customer", "c_nationkey AS nation,", _PLOT, _HOLE) + ", " + _unit_cells("s", "supplier", "", _STRIP)
OVERLAY_SQL = _UNITS + " SELECT nation, CAST(count(*) AS DOUBLE) AS left_area, CAST(count(s.x) AS DOUBLE) AS shared_area, CAST(count(*) - count(s.x) AS DOUBLE) AS left_only_area FROM p LEFT JOIN s ON s.x = p.x AND s.y = p.y GROUP BY 1"
UNION_SQL = _UNITS + """, a AS (SELECT DISTINCT x, y FROM p), m AS (SELECT a.x AS ax, s.x AS sx FROM a FULL JOIN s ON a.x = s.x AND a.y = s.y)
SELECT CAST(count(ax) AS DOUBLE) AS left_area, CAST(count(CASE WHEN sx IS NOT NULL THEN ax END) AS DOUBLE) AS shared_area, CAST(count(CASE WHEN sx IS NULL THEN ax END) AS DOUBLE) AS left_only_area, CAST(count(sx) AS DOUBLE) AS right_area, CAST(count(*) AS DOUBLE) AS union_area FROM m"""



def simplify(spark, d):
    """Strips between each row of the grid, drawn as a line, and the next; neighbours share a line."""
    at = lambda v, i: F.struct((i * 2.0).alias("x"), (F.col("vec_id") * 10.0 + v.cast("double")).alias("y"))
    low = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", at).alias("low"))
    high = low.select((F.col("vec_id") - 1).alias("vec_id"), F.col("low").alias("high"))
    ring = F.concat("low", F.reverse("high"), F.slice("low", 1, 1))
    strips = low.join(high, "vec_id").select("vec_id", F.array(ring).alias("rings"))
    thin = Si.simplified(strips, 0.1, ["vec_id"])
    return thin.select("vec_id", F.size(F.get("rings", F.lit(0))).alias("n_points"), F.round(G.ring_area(), 4).alias("area"))

QUERIES = {
    "m32_simplify": simplify,
    "u06_overlay_areas": overlay, "a16_union_area": union_area,
    "s22_raster_files": raster_files, "m28_mask_window": mask_window,
    "m01_fill_depressions": fill_depressions, "m17_cost_distance": cost_distance, "m17_volume_limited_fill": volume_limited_fill, "m13_outlines": outlines, "m14_corridor": corridor, "h22_find_banks": find_banks, "a12_validate_marks": validate_marks, "a17_bounds": bounds,
}
ORACLES = {"u06_overlay_areas": OVERLAY_SQL, "a16_union_area": UNION_SQL, "s22_raster_files": _C + " SELECT row, col, round(value, 6) AS value FROM cells", "m28_mask_window": WINDOW_SQL, "m13_outlines": OUTLINE_SQL, "a12_validate_marks": MARK_SQL, "a17_bounds": BOUND_SQL}
