"""Outlines of masks as rings, found by list ranking.

The border of a mask is its cells' sides that have no cell behind them, each a directed edge with the mask on its left.  At
every corner each arriving edge goes on with one leaving edge, so edges form rings.  Within a tile edges are
stitched to chains; only chains, a few for each side of a tile that a border crosses, take part in the ranking: by
pointer doubling every chain learns the smallest chain of its ring, and then how many corners of the ring come before its own.
A component of any size is spread over all tiles that it crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.graph import checkpointed
from hydrospark.operators.raster import Grid, cell_area
from hydrospark.session import ship

TILE = 128
_MID = 1 << 28
#: Right, up, left, down, as steps of (row, col); a left turn is the next one.
_STEPS = ((0, 1), (-1, 0), (0, -1), (1, 0))


def _edge(r, c, d):
    """The number of the edge that leaves corner (r, c) in direction d."""
    return F.shiftleft((r + _MID).cast("long"), 31).bitwiseOR(F.shiftleft((c + _MID).cast("long"), 2)).bitwiseOR(d.cast("long"))


def border_links(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``g, r, c, come, go``: at corner (r, c) of group ``g`` the edge that arrives in one direction goes on in the other."""
    r, c = F.col("row"), F.col("col")
    g = F.to_json(F.struct(*by)) if by else F.lit("{}")
    # The sides of a cell against the clock, seen with rows going down: the cell is on the left.
    sides = ((r + 1, c, 0), (r + 1, c + 1, 1), (r, c + 1, 2), (r, c, 3))
    side = lambda p, q, d: F.struct(p.cast("long").alias("r"), q.cast("long").alias("c"), F.lit(d).alias("d"))
    each = mask.select(g.alias("g"), F.explode(F.array(*[side(*s) for s in sides])).alias("e")).select("g", "e.*")
    # A side between two cells comes once each way: as the lesser end and an axis they are equal, and both go.
    dr = F.element_at(F.array(*[F.lit(s[0]) for s in _STEPS]), F.col("d") + 1)
    dc = F.element_at(F.array(*[F.lit(s[1]) for s in _STEPS]), F.col("d") + 1)
    ends = each.withColumns({"r1": F.col("r") + dr, "c1": F.col("c") + dc})
    alone = ends.groupBy("g", F.least("r", "r1").alias("a"), F.least("c", "c1").alias("b"), (F.col("d") % 2).alias("axis")).agg(F.count("*").alias("n"), F.min(F.struct("r", "c", "d", "r1", "c1")).alias("e")).where("n = 1").select("g", "e.*")
    corner = lambda p, q, kind: F.struct(F.col(p).alias("r"), F.col(q).alias("c"), F.lit(kind).alias("goes"), "d")
    meet = alone.select("g", F.explode(F.array(corner("r", "c", True), corner("r1", "c1", False))).alias("m")).select("g", "m.*")
    pairs = meet.groupBy("g", "r", "c").agg(F.collect_set(F.when(F.col("goes"), F.col("d"))).alias("out"), F.collect_set(F.when(~F.col("goes"), F.col("d"))).alias("come"))
    # Of two ways on (where two cells touch at a corner), the left turn keeps each ring simple.
    on = pairs.select("g", "r", "c", "out", F.explode("come").alias("come"))
    left = (F.col("come") + 1) % 4
    return on.select("g", "r", "c", "come", F.when(F.size("out") == 1, F.get("out", F.lit(0))).otherwise(left).alias("go"))


def _chains(links: DataFrame, tile: int) -> DataFrame:
    """``g, tail, prev, n, cross, points``: edges stitched within tiles; a chain without a ``prev`` is a whole ring."""
    ship(links.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = {}  # an edge by group and number: (number of the one before, place, whether it bends here)
        number = lambda r, c, d: (r + _MID) << 31 | (c + _MID) << 2 | d
        for g, r, c, come, go in pdf[["g", "r", "c", "come", "go"]].itertuples(index=False, name=None):
            dr, dc = _STEPS[come]
            at[g, number(r, c, go)] = (number(r - dr, c - dc, come), r, c, go, come != go)
        after = {(g, e[0]): i for (g, i), e in at.items()}
        out, seen = [], set()

        def chain(g, start, prev):
            points, cross, i = [], 0, start
            while True:
                seen.add((g, i))
                _, r, c, d, bends = at[g, i]
                if bends:
                    points.append({"r": r, "c": c})
                cross += r * _STEPS[d][1] - c * _STEPS[d][0]
                on = after.get((g, i))
                if on is None or on == start:
                    break
                i = on
            out.append((g, i, prev, len(points), cross, points))

        for (g, i), e in at.items():
            if (g, e[0]) not in at:
                chain(g, i, e[0])
        for g, i in sorted(at):  # what is left are rings within the tile
            if (g, i) not in seen:
                chain(g, i, None)
        names = ["g", "tail", "prev", "n", "cross", "points"]
        kinds = {"prev": "Int64"}  # a null among long numbers must not make floats of them
        return pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=kinds.get(c)) for k, c in enumerate(names)})

    dealt = links.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    return dealt.groupBy("tr", "tc").applyInPandas(run, "g string, tail long, prev long, n long, cross long, points array<struct<r:long,c:long>>")


def ranked_chains(mask: DataFrame, by: Sequence[str] = (), tile: int = TILE, max_rounds: int = 64) -> DataFrame:
    """``g, ring, before, n, cross, points``: every chain of the border, its ring, and the corners of the ring that come before its own."""
    chains = checkpointed(_chains(border_links(mask, by), tile))
    whole = chains.where("prev is null").select("g", F.col("tail").alias("ring"), F.lit(0).cast("long").alias("before"), "n", "cross", "points")
    open_ = chains.where("prev is not null")
    if open_.isEmpty():
        return whole
    state = checkpointed(open_.select("g", F.col("tail").alias("id"), F.col("prev").alias("ptr"), F.col("tail").alias("least")))
    for _ in range(max_rounds):
        back = state.select("g", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("least").alias("other"))
        state = checkpointed(state.join(back, ["g", "ptr"]).select("g", "id", F.col("next").alias("ptr"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("fell")))
        if state.where("fell").isEmpty():  # nobody learns of a smaller one: each has seen its whole ring
            break
    else:
        raise RuntimeError("rings did not settle")
    known = state.select("g", F.col("id").alias("tail"), F.col("least").alias("ring"))
    cut = open_.select("g", "tail", "prev", "n").join(known, ["g", "tail"])
    sizes = cut.select("g", F.col("tail").alias("prev"), F.col("n").alias("m"))
    first = F.col("tail") == F.col("ring")
    rank = checkpointed(cut.join(sizes, ["g", "prev"]).select("g", "tail", F.when(~first, F.col("prev")).alias("ptr"), F.when(first, 0).otherwise(F.col("m")).cast("long").alias("before")))
    for _ in range(max_rounds):
        if rank.where("ptr is not null").isEmpty():
            break
        back = rank.select("g", F.col("tail").alias("ptr"), F.col("ptr").alias("next"), F.col("before").alias("more"))
        rank = checkpointed(rank.join(back, ["g", "ptr"], "left").select("g", "tail", F.col("next").alias("ptr"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before")))
    ranked = open_.join(known, ["g", "tail"]).join(rank.select("g", "tail", "before"), ["g", "tail"]).select("g", "ring", "before", "n", "cross", "points")
    return whole.unionByName(ranked)


def _named(df: DataFrame, mask: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.drop("g")
    kinds = ", ".join(f"`{n}` {t}" for n, t in mask.dtypes if n in by)
    parsed = F.from_json("g", kinds)
    return df.select(*[parsed[k].alias(k) for k in by], *[c for c in df.columns if c != "g"])


def outline_points(mask: DataFrame, grid: Grid, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """``by, ring, seq, x, y``: the corners of the border in their order, mask on the left; holes run the other way."""
    a, b, c, d, e, f = grid
    each = ranked_chains(mask, by, tile).select("g", "ring", "before", F.posexplode("points").alias("k", "p"))
    row, col = F.col("p.r"), F.col("p.c")
    return _named(each.select("g", "ring", (F.col("before") + F.col("k")).alias("seq"), (c + col * a + row * b).alias("x"), (f + col * d + row * e).alias("y")), mask, by)


def ring_table(mask: DataFrame, grid: Grid, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """``by, ring, n_points, area``: rings with their signed areas (holes count against), summed chain by chain."""
    sums = ranked_chains(mask, by, tile).groupBy("g", "ring").agg(F.sum("n").alias("n_points"), (F.sum("cross") * (0.5 * cell_area(grid))).alias("area"))
    return _named(sums, mask, by)


def outlines(mask: DataFrame, grid: Grid, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """One row for each group, its border as closed ``rings`` in map units; holes run the other way.

    A row holds a whole shape, as writers of shapes want it; ``outline_points`` and ``ring_table`` do without.
    """
    a, b, c, d, e, f = grid
    chains = ranked_chains(mask, by, tile).select("g", "ring", F.struct("before", "points").alias("s"))
    ring = chains.groupBy("g", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["points"])).alias("p"))
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.struct((c + q["c"] * a + q["r"] * b).cast("double").alias("x"), (f + q["c"] * d + q["r"] * e).cast("double").alias("y")))
    shapes = ring.select("g", F.struct("ring", closed.alias("points")).alias("s")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["points"]).alias("rings"))
    return _named(shapes, mask, by)
