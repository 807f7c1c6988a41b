"""Whole-grid operators that need paths: depression filling (``spill``) and least-cost distance.

Least cost is worked tile by tile with an exact kernel, and tiles talk by their rims alone.  The cells of a tile are
dealt once, as one row of a table bucketed by tile.  In a round the tiles whose rim was offered something cheaper
are solved anew from their seeds and their best offers, and offer on what has become cheaper at their own
rim; the table lies in the shared folder and its buckets are read where they are, so only offers are shuffled.  The rounds are as many as the tiles that a cheapest way
crosses.  At the end every tile is solved once more from its best offers, and gives its cells.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.graph import checkpointed, shared_folder
from hydrospark.operators.raster import CELL, EIGHT, FOUR, Grid, UNIT_GRID, step_length
from hydrospark.operators.spill import fill_depressions
from hydrospark.session import ship

__all__ = ["cost_distance", "fill_depressions", "volume_limited_fill"]

TILE = 128
_OFFERS = "array<struct<place:int,cost:double>>"


def _relax(z: np.ndarray, w: np.ndarray, offsets, offer: Callable[[float, float, float, int], float]) -> np.ndarray:
    """Dijkstra from all known values; ``offer(w_here, z_here, z_there, k)`` is what neighbour k is offered."""
    out = w.copy()
    heap = [(out[r, c], int(r), int(c)) for r, c in zip(*np.nonzero(np.isfinite(out) & ~np.isnan(z)))]
    heapq.heapify(heap)
    rows, cols = z.shape
    while heap:
        v, r, c = heapq.heappop(heap)
        if v > out[r, c]:
            continue
        for k, (dr, dc) in enumerate(offsets):
            i, j = r + dr, c + dc
            if 0 <= i < rows and 0 <= j < cols and z[i, j] == z[i, j]:
                n = offer(v, z[r, c], z[i, j], k)
                if n < out[i, j]:
                    out[i, j] = n
                    heapq.heappush(heap, (n, i, j))
    return out


def _tiles(cells: DataFrame, tile: int, name: str) -> DataFrame:
    """One row for each tile: its cells' places, ground and seeds, in a bucketed table, so that joins by tile do not move it."""
    ship(cells.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["row"].to_numpy() - int(key[0]) * tile) * tile + pdf["col"].to_numpy() - int(key[1]) * tile
        return pd.DataFrame({"tr": [int(key[0])], "tc": [int(key[1])], "place": [place.astype("<i4").tobytes()], "z": [pdf["z"].to_numpy().astype("<f8").tobytes()], "seed": [pdf["seed"].to_numpy().astype("u1").tobytes()]})

    dealt = cells.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)}).repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tr", "tc").groupBy("tr", "tc").applyInPandas(run, "tr long, tc long, place binary, z binary, seed binary")
    spark = cells.sparkSession
    dealt.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "tr", "tc").saveAsTable(name)
    return spark.table(name)


def _solved(t: dict, tile: int, solve: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, costs of the tile, ground of the tile) from its seeds and best offers."""
    place = np.frombuffer(t["place"], "<i4").astype(np.int64)
    z, w = np.full(tile * tile, np.nan), np.full(tile * tile, np.inf)
    z[place] = np.frombuffer(t["z"], "<f8")
    w[place[np.frombuffer(t["seed"], "u1") > 0]] = 0.0
    for o in t["offers"] or ():
        w[o["place"]] = min(w[o["place"]], o["cost"])
    return place, solve(z.reshape(tile, tile), w.reshape(tile, tile)), z.reshape(tile, tile)


def cost_distance(cells: DataFrame, seeds: DataFrame, elevation: str = "value", grid: Grid = UNIT_GRID, connectivity: int = 4, uphill_penalty: float = 8.0, tile: int = TILE, max_rounds: int = 100_000) -> DataFrame:
    """M17 (first half): ``cost`` of the cheapest way from a seed to every cell that one reaches.

    A step costs its length, times 1 + penalty for each unit that it rises.  Cells without a value let nothing through.
    """
    offsets = FOUR if connectivity == 4 else EIGHT
    steps = [step_length(dr, dc, grid) for dr, dc in offsets]
    penalty = max(float(uphill_penalty), 0.0)
    offer = lambda v, here, there, k: v + steps[k] * (1.0 + penalty * max(0.0, there - here))
    solve = lambda z, w: _relax(z, w, offsets, offer)
    kinds = dict(cells.dtypes)
    marked = cells.select("row", "col", F.col(elevation).cast("double").alias("z")).where("z is not null and not isnan(z)").join(seeds.select("row", "col", F.lit(True).alias("seed")).distinct(), CELL, "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    spark = cells.sparkSession
    name = f"cost_tiles_{uuid.uuid4().hex}"

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What rim cells that have become cheaper say to the cells beyond: their cost and height, and the way."""
        out_names = ["tr", "tc", "place", "k", "cost", "z"]
        for b in batches:
            for t in b.to_pylist():
                place, w, z = _solved(t, tile, solve)
                said = {(o["k"], o["place"]): o["cost"] for o in t["said"] or ()}
                out = []
                r, c = place // tile, place % tile
                for i, j in zip(*(x[(r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)].tolist() for x in (r, c))):
                    if not np.isfinite(w[i, j]):
                        continue
                    for k, (dr, dc) in enumerate(offsets):
                        p, q = i + dr, j + dc
                        if (0 <= p < tile and 0 <= q < tile) or w[i, j] >= said.get((k, i * tile + j), np.inf):
                            continue
                        out.append((t["tr"] + p // tile, t["tc"] + q // tile, p % tile * tile + q % tile, k, float(w[i, j]), float(z[i, j])))
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=out_names)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Offers as costs of the cell that they reach; those to where no cell is, or that are no gain, go."""
        for b in batches:
            for t in b.to_pylist():
                place = np.frombuffer(t["place"], "<i4")
                ground = dict(zip(place.tolist(), np.frombuffer(t["z"], "<f8").tolist()))
                best = {o["place"]: o["cost"] for o in t["offers"] or ()}
                before = dict(best)
                for o in t["heard"]:
                    if o["place"] in ground:
                        cost = offer(o["cost"], o["z"], ground[o["place"]], o["k"])
                        if cost < best.get(o["place"], np.inf):
                            best[o["place"]] = cost
                entry = pa.StructArray.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], names=["place", "cost"])
                yield pa.RecordBatch.from_arrays([pa.array([t["tr"]]), pa.array([t["tc"]]), pa.ListArray.from_arrays([0, len(best)], entry), pa.array([best != before])], names=["tr", "tc", "offers", "active"])

    key = ["tr", "tc"]
    try:
        tiles = _tiles(marked, tile, name)
        none = F.lit(None).cast(_OFFERS)
        # Tiles with an offer, and what they have been offered at best; first those with a seed, which need none.
        state = checkpointed(tiles.where(F.instr(F.hex("seed"), "01") > 0).select(*key, none.alias("offers"), F.lit(True).alias("active")))
        said = None
        for _ in range(max_rounds):
            active = state.where("active").select(*key, "offers")
            if active.isEmpty():
                break
            # A hash join on the shuffled side: a broadcast would leave the costly kernel to as few tasks as the small side has.
            spoken = tiles.join(active.hint("shuffle_hash"), key)
            spoken = spoken.join(said, key, "left") if said is not None else spoken.withColumn("said", F.lit(None).cast("array<struct<k:int,place:int,cost:double>>"))
            now = checkpointed(spoken.mapInArrow(offers, "tr long, tc long, place int, k int, cost double, z double"))
            heard = now.groupBy(*key).agg(F.collect_list(F.struct("place", "k", "cost", "z")).alias("heard"))
            # What a rim cell has said, kept where it said it.
            dr, dc = (F.element_at(F.array(*[F.lit(o[axis]) for o in offsets]), F.col("k") + 1) for axis in (0, 1))
            r, c = F.floor(F.col("place") / tile) - dr, F.col("place") % tile - dc
            own = now.select((F.col("tr") + F.floor(r / tile)).alias("tr"), (F.col("tc") + F.floor(c / tile)).alias("tc"), "k", (F.pmod(r, F.lit(tile)) * tile + F.pmod(c, F.lit(tile))).cast("int").alias("place"), "cost")
            old = said.select(*key, F.inline("said")) if said is not None else own.limit(0)
            least = old.unionByName(own).groupBy(*key, "k", "place").agg(F.min("cost").alias("cost"))
            said = checkpointed(least.groupBy(*key).agg(F.collect_list(F.struct("k", "place", "cost")).alias("said")))
            met = tiles.select(*key, "place", "z").join(heard.hint("shuffle_hash"), key).join(state.select(*key, "offers"), key, "left")
            new = checkpointed(met.mapInArrow(weighed, f"tr long, tc long, offers {_OFFERS}, active boolean"))
            state = checkpointed(new.unionByName(state.join(new.select(*key), key, "left_anti").withColumn("active", F.lit(False))))
        else:
            raise RuntimeError(f"tiles did not settle in {max_rounds} rounds")

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in b.to_pylist():
                    place, w, z = _solved(t, tile, solve)
                    cost = w.ravel()[place]
                    cols = [pa.array(t["tr"] * tile + place // tile), pa.array(t["tc"] * tile + place % tile), pa.array(z.ravel()[place]), pa.array(cost)]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "col", "z", "cost"]).filter(pa.array(np.isfinite(cost)))

        out = checkpointed(tiles.join(state.select(*key, "offers").hint("shuffle_hash"), key).mapInArrow(give, "row long, col long, z double, cost double"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in CELL], F.col("z").alias(elevation), "cost")


def volume_limited_fill(candidates: DataFrame, seeds: DataFrame, budget_m3: float, depth: str = "depth", elevation: str = "ground", grid: Grid = UNIT_GRID, connectivity: int = 4, uphill_penalty: float = 8.0) -> DataFrame:
    """Candidate cells filled from the seeds outwards, the cheapest to reach first, until the budget is used.

    ``candidates`` has ``row, col``, depth and elevation; cells without depth neither fill nor
    let water through.  The last cell is filled in part.
    """
    from hydrospark.operators.raster import masked, running_fill

    wet = candidates.where(F.col(depth) > 0)
    reached = cost_distance(wet, masked(seeds, keep=[wet]), elevation, grid, connectivity, uphill_penalty)
    both = checkpointed(reached.select("row", "col", "cost").join(wet, CELL))
    return running_fill(both, budget_m3, "cost", depth, grid)
