"""Operators on graphs: flow forests by pointer doubling, and connected components.

Loops run on the driver, a few joins a round; every round is checkpointed, so plans stay short
and a lost executor costs at most a round.  Only counts come back to the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where a local session has none."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node in ``links`` (columns ``a`` and ``b``); root is the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): a few shuffles a round, and rounds grow with the logarithm of the
    longest chain.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself).
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("r").alias("lo")).where("hi <> lo").distinct()
        # Small star: every smaller neighbour of a node, and the node, go to its smallest neighbour.
        least = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("r"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("r").alias("lo"))
        edges = checkpointed(small.where("hi <> lo").distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()


def follow(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(id, root, steps)``: where the pointers of ``(id, ptr)`` lead in the end, and how many there are.

    A node without a pointer (null, or to itself, or to what is no node) is its own root.
    Doubling: a round for each power of two in the longest path.
    """
    nodes = pointers.select("id", "ptr")
    known = nodes.select(F.col("id").alias("ptr"), F.lit(True).alias("__is"))
    start = nodes.join(known, "ptr", "left").select("id", F.when(F.col("__is") & (F.col("ptr") != F.col("id")), F.col("ptr")).alias("ptr"))
    state = checkpointed(start.select("id", F.coalesce("ptr", "id").alias("ptr"), F.col("ptr").isNotNull().cast("long").alias("steps"), F.col("ptr").isNull().alias("done")))
    for _ in range(max_rounds):
        if state.where("not done").limit(1).count() == 0:
            return state.select("id", F.col("ptr").alias("root"), "steps")
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("steps").alias("s2"), F.col("done").alias("d2"))
        open_ = state.where("not done").join(ahead, "ptr").select("id", F.col("p2").alias("ptr"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("d2").alias("done"))
        state = checkpointed(state.where("done").unionByName(open_))
    raise RuntimeError(f"pointers run in a circle, or over 2**{max_rounds} steps")


def accumulate(pointers: DataFrame, weight: str | None = None, max_rounds: int = 40) -> DataFrame:
    """``(id, total)``: the weight (1 if none is given) of every node and all that flow into it.

    Doubling: A(v) grows by the A(u) of those whose pointer is v, then pointers are followed once.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    nodes = pointers.select("id", F.when(F.col("ptr") != F.col("id"), F.col("ptr")).alias("ptr"), w.alias("a"))
    known = nodes.select(F.col("id").alias("ptr"))
    state = checkpointed(nodes.join(known, "ptr", "left_semi").unionByName(nodes.join(known, "ptr", "left_anti").withColumn("ptr", F.lit(None).cast(nodes.schema["ptr"].dataType)).select("ptr", "id", "a")))
    for _ in range(max_rounds):
        if state.where("ptr is not null").limit(1).count() == 0:
            return state.select("id", F.col("a").alias("total"))
        came = state.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("a").alias("more"))
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"))
        state = checkpointed(state.join(came, "id", "left").join(ahead, "ptr", "left").select("id", F.col("p2").alias("ptr"), (F.col("a") + F.coalesce("more", F.lit(0.0))).alias("a")))
    raise RuntimeError(f"pointers run in a circle, or over 2**{max_rounds} steps")


def basin(pointers: DataFrame, outlets: DataFrame) -> DataFrame:
    """``(id, outlet)`` of every node that drains through an outlet (column ``id``); the first one met counts."""
    stop = outlets.select("id", F.lit(True).alias("__o"))
    cut = pointers.join(stop, "id", "left").select("id", F.when(F.col("__o").isNull(), F.col("ptr")).alias("ptr"))
    return follow(cut).join(outlets.select(F.col("id").alias("root")), "root", "left_semi").select("id", F.col("root").alias("outlet"))


def main_upstream(pointers: DataFrame, area: DataFrame) -> DataFrame:
    """``(id, up)``: of the nodes that flow into a node, the one with the most area (ties: the lowest id)."""
    return pointers.join(area, "id").where("ptr <> id").groupBy("ptr").agg(F.max_by("id", F.struct("total", -F.col("id"))).alias("up")).withColumnRenamed("ptr", "id")


def mainstem(pointers: DataFrame, area: DataFrame, outlet: DataFrame, least_area: float) -> DataFrame:
    """``(id, path_index)`` along the dominant upstream path from the outlet (index 0).

    The path goes on to the main tributary as long as that has ``least_area``.
    """
    up = main_upstream(pointers, area).select(F.col("id").alias("ptr"), F.col("up").alias("id"), F.lit(True).alias("__main"))
    on = pointers.join(area, "id").join(up, ["id", "ptr"], "left").join(outlet.select("id", F.lit(True).alias("__o")), "id", "left")
    chain = on.select("id", F.when(F.col("__o").isNull() & F.col("__main") & (F.col("total") >= least_area), F.col("ptr")).alias("ptr"))
    return follow(chain).join(outlet.select(F.col("id").alias("root")), "root", "left_semi").select("id", F.col("steps").alias("path_index"))


def trace_down(pointers: DataFrame, starts: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(start, id, steps)``: every node on the way from each start, itself included.

    The set of nodes met doubles each round, by pointers of doubled reach.
    """
    jump = checkpointed(pointers.where("ptr is not null and ptr <> id").select("id", "ptr"))
    met = starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("steps"))
    reach = 1
    for _ in range(max_rounds):
        more = met.join(jump, "id").select("start", F.col("ptr").alias("id"), (F.col("steps") + reach).alias("steps"))
        met = checkpointed(met.unionByName(more))
        jump = checkpointed(jump.join(jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2")), "ptr").select("id", F.col("p2").alias("ptr")))
        reach *= 2
        if jump.limit(1).count() == 0:
            return met
    raise RuntimeError(f"pointers run in a circle, or over 2**{max_rounds} steps")


def selected_branch(pointers: DataFrame, area: DataFrame, start: DataFrame, outlet: DataFrame, least_area: float) -> DataFrame:
    """Nodes of the branch through ``start``: down to the outlet, and up along the main path.

    Empty if the start does not drain to the outlet.
    """
    down = trace_down(pointers, start)
    hit = down.join(outlet.select("id"), "id").select(F.col("steps").alias("__last"), "start")
    below = down.join(hit, "start").where(F.col("steps") <= F.col("__last")).select("id")
    above = mainstem(pointers, area, start, least_area).select("id")
    reached = below.limit(1).select(F.lit(1).alias("__k"))
    return below.unionByName(above).distinct().withColumn("__k", F.lit(1)).join(F.broadcast(reached), "__k", "left_semi").select("id")


def height_above_drain(pointers: DataFrame, elevation: DataFrame, drains: DataFrame) -> DataFrame:
    """``(id, drain, drain_elevation, hand)`` of every node that reaches a drain; a tiny negative height becomes 0."""
    found = basin(pointers, drains)
    z = elevation.select("id", "z")
    out = found.join(z, "id").join(z.select(F.col("id").alias("outlet"), F.col("z").alias("drain_elevation")), "outlet")
    h = F.col("z") - F.col("drain_elevation")
    return out.select("id", F.col("outlet").alias("drain"), "drain_elevation", F.when((h < 0) & (h > -0.01), 0.0).otherwise(h).alias("hand"))


def seeded_components(cells: DataFrame, links: DataFrame, seeds: DataFrame, least: int = 1) -> DataFrame:
    """``(id, root)`` of the components that hold a seed and have at least ``least`` nodes."""
    return seeded(cells.select("id").join(components(links).withColumnsRenamed({"node": "id"}), "id", "left").select("id", F.coalesce("root", "id").alias("root")), seeds, least)


def seeded(label: DataFrame, seeds: DataFrame, least: int = 1) -> DataFrame:
    """``seeded_components`` of nodes that have their root: ``label`` has ``id, root``."""
    big = label.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("root")
    touched = label.join(seeds.select("id"), "id", "left_semi").select("root").distinct()
    return label.join(big, "root", "left_semi").join(touched, "root", "left_semi").select("id", "root")

