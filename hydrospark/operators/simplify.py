"""Simplification that keeps topology: shapes are made of arcs, neighbours share them, and each arc is thinned once.

An arc runs between corners where more or fewer than two ways meet.  After thinning, an arc that crosses or touches
another, or behind whose new line another arc has come to lie, is thinned again by half the tolerance, and in the end
stays as it was; so shapes that did not cross do not cross afterwards, and borders have no gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators.geometry import kept_points
from hydrospark.operators.graph import checkpointed
from hydrospark.session import ship

_POINTS = "array<struct<x:double,y:double>>"
#: At this level an arc stays as it was.
LAST = 5


def _digest(*columns: str):
    """Sixteen bytes that stand for values in keys of joins."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def _arcs(shapes: DataFrame) -> DataFrame:
    """``sid, ring, place, turned, name, points``: the arcs of every ring in their order, each in its one direction."""
    rings = shapes.select("sid", F.posexplode("rings").alias("ring", "line"))
    clean = F.filter("line", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # A point that comes twice in a row is one.
    rings = rings.withColumn("line", F.filter(clean, lambda p, i: (i == 0) | (F.get(clean, i - 1) != p))).where(F.size("line") >= 2)
    pairs = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    sides = rings.select(F.explode(pairs).alias("s"))
    ways = sides.select(F.explode(F.array(F.struct("s.p", "s.q"), F.struct(F.col("s.q").alias("p"), F.col("s.p").alias("q")))).alias("w")).select("w.p", "w.q").distinct()
    # Two ways meet at an inner point of an arc; ends of open lines are corners whatever meets there.
    inner = ways.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p")
    ends = rings.where(F.get("line", F.lit(0)) != F.element_at("line", -1)).select(F.explode(F.array(F.get("line", F.lit(0)), F.element_at("line", -1))).alias("p")).distinct()
    inner = inner.join(ends, "p", "left_anti").withColumn("inner", F.lit(True))
    each = rings.select("sid", "ring", F.posexplode("line").alias("k", "p")).join(inner, "p", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        pts = [(q["x"], q["y"]) for q in pdf["p"]]
        stop = [v is not True for v in pdf["inner"]]
        if pts[0] == pts[-1] and len(pts) > 2:
            # A closed way begins at its first corner, or at its smallest point where it has none.
            pts, stop = pts[:-1], stop[:-1]
            at = stop.index(True) if any(stop) else pts.index(min(pts))
            pts, stop = pts[at:] + pts[: at + 1], [True, *stop[at + 1 :], *stop[:at], True]
        stop[0] = stop[-1] = True
        cuts = [k for k, s in enumerate(stop) if s]
        out = []
        for place, (a, b) in enumerate(zip(cuts, cuts[1:])):
            way = pts[a : b + 1]
            turned = way[::-1] < way
            out.append((pdf["sid"].iloc[0], pdf["ring"].iloc[0], place, turned, [{"x": x, "y": y} for x, y in (way[::-1] if turned else way)]))
        return pd.DataFrame(out, columns=["sid", "ring", "place", "turned", "points"])

    found = each.groupBy("sid", "ring").applyInPandas(run, f"sid binary, ring int, place int, turned boolean, points {_POINTS}")
    return found.withColumn("name", _digest("points"))


def _thinned(arcs: DataFrame, tolerance: float) -> DataFrame:
    """``arc, level, points, line``: the line that stays of each arc at its level."""

    def line(points, level):
        p = np.array([(q["x"], q["y"]) for q in points], float)
        closed = (p[0] == p[-1]).all()
        for k in range(int(level), LAST + 1):
            keep = kept_points(p, tolerance / 2**k) if k < LAST else np.ones(len(p), bool)
            if not closed or keep.sum() >= 4:  # a ring needs three points
                break
        return [{"x": float(x), "y": float(y)} for x, y in p[keep]]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(line=[line(p, k) for p, k in zip(pdf["points"], pdf["level"])])

    return arcs.select("arc", "level", "points").mapInPandas(run, f"arc long, level int, points {_POINTS}, line {_POINTS}")


def _tile(arcs: DataFrame, tolerance: float) -> float:
    """Ten tolerances, or twice the length that nine of ten sides reach, if that is more: so a side is in few tiles."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda k: F.hypot(F.get("line", k)["x"] - F.get("line", k - 1)["x"], F.get("line", k)["y"] - F.get("line", k - 1)["y"]))
    side = arcs.select(F.explode(pairs).alias("s")).where("s > 0 and s < double('infinity')").agg(F.percentile_approx("s", F.lit(0.1))).first()[0]
    return max(10 * tolerance, 2 * float(side or 0.0))


def _conflicts(arcs: DataFrame, tile: float) -> DataFrame:
    """``arc``: arcs, not yet as they were, whose line meets another's outside common ends, or goes around another arc."""
    n_tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = lambda lo, hi, size=tile: F.sequence(F.floor(lo / size), F.floor(hi / size))
    pairs = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda k: F.struct(k.alias("k"), F.get("line", k - 1).alias("p"), F.get("line", k).alias("q")))
    seg = arcs.select("arc", "level", F.explode(pairs).alias("s")).select("arc", "level", "s.k", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))
    # A long side goes to the tiles of its pieces, each at most one tile long; each tile once.
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / tile), F.lit(1)).cast("long")
    piece = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t

    def of_piece(i):
        t0, t1 = i / n, (i + 1) / n
        xs, ys = (piece("x0", "x1", t0), piece("x0", "x1", t1)), (piece("y0", "y1", t0), piece("y0", "y1", t1))
        return F.flatten(F.transform(tiles(F.least(*xs), F.greatest(*xs)), lambda tx: F.transform(tiles(F.least(*ys), F.greatest(*ys)), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))

    spread = seg.select("*", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), of_piece)))).alias("t")).select(*seg.columns, "t.tx", "t.ty")
    spread = spread.repartition(n_tasks, "tx", "ty")  # the same shuffle for both sides
    other = spread.withColumnsRenamed({c: f"o_{c}" for c in seg.columns})
    met = spread.join(other, ["tx", "ty"]).where(f"(arc, k) < (o_arc, o_k) and (level < {LAST} or o_level < {LAST})")
    side = lambda a, b, c: (F.col(b[0]) - F.col(a[0])) * (F.col(c[1]) - F.col(a[1])) - (F.col(b[1]) - F.col(a[1])) * (F.col(c[0]) - F.col(a[0]))
    a, b, c, d = ("x0", "y0"), ("x1", "y1"), ("o_x0", "o_y0"), ("o_x1", "o_y1")
    same = lambda p, q: (F.col(p[0]) == F.col(q[0])) & (F.col(p[1]) == F.col(q[1]))
    between = lambda p, q, r: F.col(r[0]).between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & F.col(r[1]).between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    on = lambda p, q, r: (side(p, q, r) == 0) & between(p, q, r) & ~same(p, r) & ~same(q, r)
    cross = (F.signum(side(a, b, c)) * F.signum(side(a, b, d)) < 0) & (F.signum(side(c, d, a)) * F.signum(side(c, d, b)) < 0)
    equal = (same(a, c) & same(b, d)) | (same(a, d) & same(b, c))
    hit = met.where(cross | equal | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b))
    crossing = hit.select(F.explode(F.array(F.struct("arc", "level"), F.struct(F.col("o_arc").alias("arc"), F.col("o_level").alias("level")))).alias("e")).select("e.*")
    # What lies between an arc and its line: the arc there, the line back.  One point of each other arc is enough, as none crosses.
    # Boxes meet ends of arcs first, in tiles of a size at which a box touches few, and only arcs with an end in their box bring their points.
    lens = arcs.where(F.size("line") < F.size("points"))
    end = lambda f, axis: f(F.transform("points", lambda p: p[axis]))
    box = lens.select("arc", F.get("points", F.lit(0)).alias("p"), F.element_at("points", -1).alias("q"), end(F.array_min, "x").alias("x0"), end(F.array_max, "x").alias("x1"), end(F.array_min, "y").alias("y0"), end(F.array_max, "y").alias("y1"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.withColumn("step", F.aggregate(F.array(*[F.lit(k) for k in range(1, 16)]), F.lit(0), lambda s, k: F.when(wide > 4 * tile * F.pow(F.lit(8.0), s), k).otherwise(s)))
    steps = sorted(r[0] for r in box.select("step").distinct().collect())  # sixteen at most
    size = tile * F.pow(F.lit(8.0), F.col("step"))
    box = box.select("*", F.explode(tiles(F.col("x0"), F.col("x1"), size)).alias("tx")).select("*", F.explode(tiles(F.col("y0"), F.col("y1"), size)).alias("ty"))
    marks = arcs.select(F.explode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1))).alias("m")).distinct()
    marks = marks.select("m", F.explode(F.array(*map(F.lit, steps)).cast("array<int>")).alias("step")).select("m", "step", F.floor(F.col("m.x") / size).alias("tx"), F.floor(F.col("m.y") / size).alias("ty"))
    held = F.col("m.x").between(F.col("x0"), F.col("x1")) & F.col("m.y").between(F.col("y0"), F.col("y1")) & (F.col("m") != F.col("p")) & (F.col("m") != F.col("q"))
    asked = box.join(marks, ["step", "tx", "ty"]).where(held).select("arc", "m")
    near = asked.join(lens.select("arc", "level", F.array(F.concat("points", F.reverse("line"))).alias("rings")), "arc")
    own = F.exists(F.get("rings", F.lit(0)), lambda p: p == F.col("m"))
    around = near.where(~own & X.point_in_rings(F.col("m.x"), F.col("m.y"), "rings")).select("arc", "level")
    return crossing.unionByName(around).where(F.col("level") < LAST).select("arc").distinct()


def simplified(shapes: DataFrame, tolerance: float, keys: Sequence[str], tile: float | None = None) -> DataFrame:
    """``keys, rings``: lines and rings without points that lie within the tolerance of what stays, borders still shared.

    ``keys`` name a row; rows of equal keys and shapes are one.  ``tile`` (map units; if not given ten tolerances, or more where sides are longer) is how
    far arcs are compared at a time.  Points with a missing coordinate and rings of one point are left out, and so are
    rows without a ring; a ring keeps three points.  Where shapes cross before, the arcs that cross stay as they were.
    """
    ship(shapes.sparkSession)
    named = shapes.select(*keys, "rings").withColumn("sid", _digest(*keys, "rings")).dropDuplicates(["sid"])
    used = checkpointed(_arcs(named))
    # Arcs are numbered once; what is compared and shuffled carries the number.
    names = checkpointed(used.groupBy("name").agg(F.first("points").alias("points")).withColumn("arc", F.monotonically_increasing_id()))
    arcs = checkpointed(_thinned(names.withColumn("level", F.lit(0)), tolerance))
    tile = float(tile or _tile(arcs, tolerance))
    while True:  # every round takes an arc with a conflict to its next level, and there are few levels
        bad = checkpointed(_conflicts(arcs, tile))
        if bad.isEmpty():
            break
        again = arcs.join(bad, "arc", "left_semi").withColumn("level", F.col("level") + 1)
        arcs = checkpointed(arcs.join(bad, "arc", "left_anti").unionByName(_thinned(again, tolerance)))
    lines = names.select("name", "arc").join(arcs.select("arc", "line"), "arc").drop("arc")
    parts = used.drop("points").join(lines, "name").select("sid", "ring", F.struct("place", F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line")).alias("line")).alias("a"))
    # Arcs of a ring follow one another; each but the first leaves out the point that it shares with the one before.
    whole = parts.groupBy("sid", "ring").agg(F.array_sort(F.collect_list("a")).alias("a"))
    line = F.flatten(F.transform("a", lambda v, i: F.when(i == 0, v["line"]).otherwise(F.slice(v["line"], 2, F.greatest(F.size(v["line"]) - 1, F.lit(0))))))
    rings = whole.select("sid", F.struct("ring", line.alias("line")).alias("r")).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("rings"))
    return named.drop("rings").join(rings, "sid").select(*keys, "rings")
