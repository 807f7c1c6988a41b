"""Depression filling by a spill graph: two passes over the cells, whatever the terrain.

Each tile is flooded by itself from its rim, lowest cell first.  A watershed is what one rim cell
floods; what leaves a tile is its rim (a few cells in a hundred) and, for every two watersheds that touch,
the lowest level at which one spills into the other.  Rims of neighbouring tiles are joined to the graph of
all watersheds, and each watershed's level is the least, over its ways to the outside, of the highest spill on the way.  The
second pass raises each tile's cells to their watershed's level.

The levels come by contraction: every watershed hooks to the neighbour across its lowest spill, hooked
trees become one, and at least half of the watersheds are gone after each round; cells take no part in it.  When no more
than ``SMALL_GRAPH`` spills are left, the driver solves the rest at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.graph import checkpointed
from hydrospark.session import ship

#: The node for the outside, smaller than all others.
OUTSIDE = -(1 << 62)
SMALL_GRAPH = 100_000
_EDGES = "array<struct<a:int,b:int,w:double>>"
_RIM = "array<struct<row:long,col:long,label:int,z:double>>"


def flooded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Levels and watersheds of a tile that is flooded from its rim, and the least spill of each touching pair.

    NaN is no cell; a cell beside such a hole drains there, to watershed 0.  A cell where none is has watershed -1.
    """
    rows, cols = z.shape
    wide = cols + 2
    padded = np.full((rows + 2, wide), np.nan)
    padded[1:-1, 1:-1] = z
    there = ~np.isnan(padded)
    hole = np.zeros(there.shape, bool)
    inner_gap = ~there
    inner_gap[[0, -1], :] = inner_gap[:, [0, -1]] = False
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            hole |= np.roll(inner_gap, (dr, dc), (0, 1))
    hole &= there
    start = hole.copy()
    start[[1, -2], :] |= there[[1, -2], :]
    start[:, [1, -2]] |= there[:, [1, -2]]
    level = np.where(start, padded, np.inf).ravel().tolist()
    label = np.where(hole, 0, -1).ravel().tolist()
    ground, at = padded.ravel().tolist(), np.flatnonzero(start).tolist()
    heap = [(ground[i], i) for i in at]
    heapq.heapify(heap)
    queued = start.ravel().tolist()
    spills: dict[tuple[int, int], float] = {}
    steps = (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1)
    new = 0
    while heap:
        v, i = heapq.heappop(heap)
        own = label[i]
        if own < 0:
            new += 1
            own = label[i] = new
        for d in steps:
            j = i + d
            g = ground[j]
            if g != g:
                continue
            other = label[j]
            if other < 0:
                label[j] = own
                if not queued[j]:
                    queued[j] = True
                    level[j] = g if g > v else v
                    heapq.heappush(heap, (level[j], j))
            elif other != own:
                over = level[j] if level[j] > v else v
                pair = (own, other) if own < other else (other, own)
                if over < spills.get(pair, np.inf):
                    spills[pair] = over
    cut = lambda x: np.array(x).reshape(rows + 2, wide)[1:-1, 1:-1]
    return cut(level), cut(label), spills


def _node(label):
    """The number of a tile's watershed; 0 is the outside."""
    own = F.shiftleft(F.col("tr"), 38).bitwiseOR(F.shiftleft(F.col("tc").bitwiseAND(F.lit((1 << 22) - 1)), 16)).bitwiseOR(label.cast("long"))
    return F.when(label == 0, F.lit(OUTSIDE)).otherwise(own)


def flooded_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """First pass: one row for each tile, with its cells' places, ground, levels and watersheds, its spills and its rim."""
    if not 0 < tile <= 4096:
        raise ValueError("a tile is 1 to 4096 cells wide")
    ship(cells.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        r, c = pdf["row"].to_numpy() - tr * tile, pdf["col"].to_numpy() - tc * tile
        z = np.full((tile, tile), np.nan)
        z[r, c] = pdf["z"].to_numpy(float)
        w, label, spills = flooded(z)
        rim = ((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)) & (label[r, c] >= 0)
        return pd.DataFrame({
            "tr": [tr], "tc": [tc], "place": [(r * tile + c).astype("<i4").tobytes()], "z": [z[r, c].astype("<f8").tobytes()], "w": [w[r, c].astype("<f8").tobytes()], "label": [label[r, c].astype("<i4").tobytes()],
            "spills": [[{"a": a, "b": b, "w": s} for (a, b), s in spills.items()]],
            "rim": [[{"row": int(i + tr * tile), "col": int(j + tc * tile), "label": int(label[i, j]), "z": float(z[i, j])} for i, j in zip(r[rim].tolist(), c[rim].tolist())]],
        })

    dealt = cells.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    return checkpointed(dealt.groupBy("tr", "tc").applyInPandas(run, f"tr long, tc long, place binary, z binary, w binary, label binary, spills {_EDGES}, rim {_RIM}"))


def spill_graph(tiles: DataFrame, tile: int) -> DataFrame:
    """``a, b, w``: the least spill between every two watersheds that touch, within tiles and across their rims."""
    inner = tiles.select("tr", "tc", F.explode("spills").alias("s")).select(_node(F.col("s.a")).alias("a"), _node(F.col("s.b")).alias("b"), F.col("s.w").alias("w"))
    rim = tiles.select("tr", "tc", F.explode("rim").alias("c")).select("c.row", "c.col", _node(F.col("c.label")).alias("node"), "c.z")
    near = F.array(*[F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    away = rim.select("row", "col", "node", "z", F.explode(near).alias("n")).where((F.floor(F.col("n.r") / tile) != F.floor(F.col("row") / tile)) | (F.floor(F.col("n.c") / tile) != F.floor(F.col("col") / tile)))
    other = rim.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("node").alias("b"), F.col("z").alias("zb"))
    met = away.select(F.col("node").alias("a"), F.col("z").alias("za"), "n.r", "n.c").join(other, ["r", "c"], "left")
    across = met.select("a", F.coalesce("b", F.lit(OUTSIDE)).alias("b"), F.greatest("za", "zb").alias("w"))
    return _least(inner.unionByName(across))


def _least(edges: DataFrame) -> DataFrame:
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.where("a <> b").select(lo, hi, "w").groupBy("a", "b").agg(F.min("w").alias("w"))


def _roots(hooks: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, root, m``: where the hooks ``(id, ptr, w)`` lead, and the highest spill on the way; by pointer doubling."""
    state = checkpointed(hooks.select("id", F.col("ptr").alias("root"), F.col("w").alias("m"), F.lit(False).alias("done")))
    for _ in range(max_rounds):
        on = state.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("m").alias("more"), F.lit(True).alias("goes"))
        live = state.where("not done").join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.greatest("m", "more").alias("m"), F.col("goes").isNull().alias("done"))
        state = checkpointed(state.where("done").unionByName(live))
        if state.where("not done").isEmpty():
            return state.drop("done")
    raise RuntimeError("hooks did not settle")


def _solved(edges: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """Levels of the nodes of a small graph, lowest way first."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    level: dict[int, float] = {}
    heap = [(-np.inf, OUTSIDE)]
    while heap:
        v, a = heapq.heappop(heap)
        if a in level:
            continue
        level[a] = v
        for b, w in near.get(a, ()):
            if b not in level:
                heapq.heappush(heap, (max(v, w), b))
    return [(a, v) for a, v in level.items() if a != OUTSIDE]


def spill_levels(graph: DataFrame, small: int = SMALL_GRAPH, max_rounds: int = 64) -> DataFrame:
    """``node, level``: the least, over all ways from the node to the outside, of the highest spill on the way."""
    spark = graph.sparkSession
    edges = checkpointed(graph)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().where(F.col("node") != OUTSIDE)
    known = nodes.select("node", F.col("node").alias("now"), F.lit(float("-inf")).alias("m"))
    for _ in range(max_rounds):
        rest = edges.limit(small + 1).count()
        if rest <= small:
            level = spark.createDataFrame(_solved([tuple(r) for r in edges.collect()]), "now long, level double")
            found = known.join(F.broadcast(level), "now", "left") if rest else known.withColumn("level", F.lit(None).cast("double"))
            return found.select("node", F.greatest("m", F.coalesce("level", F.lit(float("-inf")))).alias("level"))
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("ptr"), "w").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("ptr"), "w"))
        # Of equal spills the same one is lowest for both sides, so hooks close no circle but that of two.
        order = F.struct("w", F.least("id", "ptr").alias("x"), F.greatest("id", "ptr").alias("y"), "ptr")
        hooks = checkpointed(both.where(F.col("id") != OUTSIDE).groupBy("id").agg(F.min(order).alias("e")).select("id", "e.ptr", "e.w"))
        back = hooks.select(F.col("id").alias("ptr"), F.col("ptr").alias("back"))
        hooks = hooks.join(back, "ptr", "left").where((F.col("back").isNull()) | (F.col("back") != F.col("id")) | (F.col("id") > F.col("ptr"))).select("id", "ptr", "w")
        roots = _roots(hooks)
        to = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"__{c}"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"), "w")
        edges = checkpointed(_least(moved))
        step = roots.select(F.col("id").alias("now"), "root", F.col("m").alias("more"))
        known = checkpointed(known.join(step, "now", "left").select("node", F.coalesce("root", "now").alias("now"), F.greatest("m", "more").alias("m")))
    raise RuntimeError("watersheds did not settle")


def fill_depressions(cells: DataFrame, value: str = "value", tile: int = 128, small: int = SMALL_GRAPH) -> DataFrame:
    """``filled``, the least level at which water leaves over the edge, and ``fill_depth``.

    Water leaves from cells that have a neighbour missing (the rim of the raster and of holes); a
    cell without a value is a hole, and has no level itself.
    """
    kinds = dict(cells.dtypes)
    tiles = flooded_tiles(cells.select("row", "col", F.col(value).cast("double").alias("z")), tile)
    levels = spill_levels(spill_graph(tiles, tile), small)
    # Back to tiles: the tile is in the number of a node, so the join moves what a tile holds once.
    bits = F.col("node")
    tr, tc = F.shiftright(bits, 38), F.shiftright(F.shiftleft(F.shiftright(bits, 16), 42), 42)
    by_tile = levels.select(tr.alias("tr"), tc.alias("tc"), F.struct((bits.bitwiseAND(F.lit(65535))).cast("int").alias("k"), "level").alias("s")).groupBy("tr", "tc").agg(F.collect_list("s").alias("levels"))

    def raise_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                place, label = np.frombuffer(t["place"], "<i4").astype(np.int64), np.frombuffer(t["label"], "<i4")
                z, w = np.frombuffer(t["z"], "<f8"), np.frombuffer(t["w"], "<f8")
                level = np.full(max(int(label.max(initial=0)), 0) + 1, -np.inf)
                for s in t["levels"] or ():
                    level[s["k"]] = s["level"]
                none = label < 0
                filled = np.maximum(w, level[np.maximum(label, 0)])
                cols = [pa.array(t["tr"] * tile + place // tile), pa.array(t["tc"] * tile + place % tile), pa.array(z, mask=none), pa.array(filled, mask=none), pa.array(np.maximum(filled - z, 0.0), mask=none)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "col", "z", "filled", "fill_depth"])

    rows = tiles.select("tr", "tc", "place", "z", "w", "label").join(by_tile, ["tr", "tc"], "left").mapInArrow(raise_cells, "row long, col long, z double, filled double, fill_depth double")
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("row", "col")], F.col("z").alias(value), "filled", "fill_depth")
