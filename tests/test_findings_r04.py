"""Findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark import catalog
from hydrospark.llm import simhash_dedup as D
from hydrospark.llm.common import stored
from hydrospark.operators import graph as G
from hydrospark.operators import raster as R


@pytest.fixture()
def joins(spark):
    """The joins of a plan by kind; everything here is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield lambda df: {k: df._jdf.queryExecution().executedPlan().toString().count(k) for k in ("BroadcastHashJoin", "SortMergeJoin")}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_arrays_are_not_broadcast(spark, joins):
    """16 rows for each fingerprint look to the planner like one."""
    distinct = stored(spark.range(2000).select(F.xxhash64("id").alias("fp"), F.sha1(F.col("id").cast("string")).cast("binary").alias("least")), "f1")
    links = D.near_links(distinct)
    assert joins(links) == {"BroadcastHashJoin": 0, "SortMergeJoin": 1}
    live = stored(distinct.select(F.col("least").alias("node"), "fp", F.array_repeat(F.col("fp") % 500, D.BANDS).alias("bands"), F.lit(9).cast("long").alias("size")), "f1-live")
    for pairs in (D.band_pairs(live), D.bucket_pairs(live)):
        assert joins(pairs)["BroadcastHashJoin"] == 0


def test_texts_are_not_broadcast(spark, joins):
    """texts are larger in memory than in files."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id") % 150, F.col("id") % 150 + 20)).alias("text"), F.lit(0).cast("long").alias("__row"))
    node = F.sha1(F.col("doc_id").cast("string")).cast("binary")
    distinct = rows.select(node.alias("node"), F.struct("doc_id", F.col("__row").alias("row")).alias("first"))
    at = lambda n: F.sha1(n.cast("string")).cast("binary")
    pairs = stored(spark.range(150).select(at(F.col("id")).alias("a"), at(F.col("id") + 150).alias("b")), "f1-pairs")
    near = D.similar(rows, distinct, pairs)
    assert joins(near)["BroadcastHashJoin"] == 0
    assert near.count() == 150


def test_target_cells_are_dealt_to_tasks(spark, joins, sf_dir):
    """cells of a few tiles are many; their places are worked once for each, in several tasks, and joined by merging."""
    out = catalog.QUERIES["m23_reproject"](spark, sf_dir)
    assert joins(out) == {"BroadcastHashJoin": 0, "SortMergeJoin": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Filter" in line and "ASIN(" in line]
    assert [line for line in plan if "RepartitionByExpression [row#" in line]


def test_places_without_a_number_have_no_value(spark):
    """a target cell that ``to_source`` sends nowhere has no value, and stays."""
    source = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, value double")
    target = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "row int, col int")
    nowhere = lambda x, y: (F.when(x > 1.0, x), y)
    out = R.resample(target, source, R.UNIT_GRID, R.UNIT_GRID, to_source=nowhere)
    assert sorted((r.row, r.col, r.value) for r in out.collect()) == [(0, 0, None), (0, 1, 2.0), (0, 2, None)]


def plain_labels(mask, ncols, around):
    root = {}
    for cell in sorted(mask):
        todo = [] if cell in root else [cell]
        while todo:
            at = todo.pop()
            if at not in root:
                root[at] = cell
                todo += [(at[0] + r, at[1] + c) for r, c in around if (at[0] + r, at[1] + c) in mask]
    return {(r * ncols + c, root[r, c][0] * ncols + root[r, c][1]) for r, c in mask}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_of_tiles_meet_at_rims(spark, connectivity):
    """snakes through many tiles, noise, one cell twice and one without a column."""
    snake = {(r, c) for r in range(0, 23, 2) for c in range(19)} | {(r, 18 if r % 4 == 1 else 0) for r in range(1, 23, 2)}
    noise = {(30 + r, c) for r in range(20) for c in range(19) if np.random.default_rng(100 * r + c).random() < 0.45}
    mask = snake | noise
    cells = spark.createDataFrame([*mask, (0, 0), (5, None)], "row int, col int")
    got = R.labels(cells, 20, connectivity, tile=5).collect()
    around = R.FOUR if connectivity == 4 else R.EIGHT
    assert {tuple(r) for r in got} == plain_labels(mask, 20, around) and len(got) == len(mask) + 1
    assert R.labels(cells.limit(0), 20, connectivity).count() == 0


def test_rounds_do_not_move_cells(spark, sf_dir, monkeypatch):
    """the graph that is solved in rounds has links of tiles, not of cells."""
    links, inner = [], G.components
    monkeypatch.setattr(G, "components", lambda found, *more: links.append(found.count()) or inner(found, *more))
    cells = catalog.QUERIES["m16_components"](spark, sf_dir).count()
    assert cells > 500 and links and max(links) < 100


@pytest.mark.parametrize("flat", [False, True])
def test_cuts_are_searched(spark, flat):
    """a cell finds its part among two hundred by a search, and the fill is that of one sorted run."""
    rows = [(r, c, 0.0 if flat and r < 40 else float((r * 37 + c * 11) % 97), 0.1 + (r + c) % 3) for r in range(60) for c in range(20)]
    cells = spark.createDataFrame(rows, "row int, col int, cost double, depth double")
    out = R.running_fill(cells, 700.0, "cost", "depth", parts=200)
    assert out._jdf.queryExecution().optimizedPlan().toString().count(" > ") < 20
    want, left = {}, 700.0
    for r, c, _, depth in sorted(rows, key=lambda x: (x[2], x[0], x[1])):
        if left > 1e-9:
            want[r, c] = min(depth, left)
            left -= want[r, c]
    got = {(x.row, x.col): x.filled_depth for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
