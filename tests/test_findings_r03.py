"""What the third round's findings named, each on a small table."""

import collections
import datetime
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from hydrospark import catalog
from hydrospark.functions import columns as X
from hydrospark.llm import context_mixing as C
from hydrospark.llm import simhash_dedup as S
from hydrospark.operators import geometry as G
from hydrospark.operators import hydraulics as H
from hydrospark.operators import matching as M
from hydrospark.operators import raster as R
from hydrospark.operators import simplify as Si
from hydrospark.operators import terrain as T
from hydrospark.plans import area as A
from hydrospark.sources import payloads as P


def _with(con, name, path):
    con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def test_ratio_counts_zeros(spark, sf_dir, tmp_path):
    """zeros, a median of zero, falling signs and nulls are as SQL has them."""
    values = [5.0, 0.0, 4.0, 6.0, 30.0, 0.0, 0.0, 0.0, 1.0, None, -2.0, -3.0, -1.0, None, None, None, None, None, 7.0]
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(hours=k), 1, "view", v, "{}") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert differences(catalog.QUERIES["w12b_outlier_ratio"](spark, str(tmp_path)), _with(connect(sf_dir), "events", tmp_path), catalog.ORACLES["w12b_outlier_ratio"]) == []


def test_equal_places_are_looked_for_once(spark, monkeypatch):
    """A thousand points in four places, and features of which sixty share a place."""
    asked = []
    inner = M._nearest
    monkeypatch.setattr(M, "_nearest", lambda points, features, *rest: asked.append((points.count(), features.count())) or inner(points, features, *rest))
    p = spark.range(1000).select(F.col("id").alias("p"), (29.0 + F.col("id") % 2).alias("lat"), (-95.0 + F.floor(F.col("id") / 2) % 2).alias("lon"))
    f = spark.range(180).select(F.col("id").alias("f"), (29.0 + F.col("id") % 3 * 0.4).alias("flat"), F.lit(-95.0).alias("flon"))
    got = M.nearest(p, f, "p", X.haversine_km("lat", "lon", "flat", "flon"), "f", n=2).select("p", "f", "rank").collect()
    assert asked == [(4, 6)]
    want = {(k, first + 3 * r, r + 1) for k in range(1000) for r in range(2) for first in [0 if k % 2 == 0 else 2]}
    assert {tuple(r) for r in got} == want and len(got) == 2000


def test_equal_boxes_meet_as_one(spark):
    """pairs of copies come out whole and are spread over tasks."""
    a = spark.range(400).select(F.col("id").alias("a"), *[(F.col("id") % 4 + k).cast("double").alias(c) for c, k in (("x0", 0.0), ("y0", 0.0), ("x1", 0.5), ("y1", 0.5))])
    b = spark.range(50).select(F.col("id").alias("b"), *[(F.col("id") % 2 + k).cast("double").alias(c) for c, k in (("tx0", 0.2), ("ty0", 0.2), ("tx1", 0.3), ("ty1", 0.3))])
    out = M.range_tiles(a, b, 1.0)
    got = [tuple(r) for r in out.select("a", "b").collect()]
    assert sorted(got) == [(i, j) for i in range(400) for j in range(50) if i % 4 == j % 2]
    assert out.select(F.spark_partition_id().alias("n")).distinct().count() > 1


def _square(x, y, h):
    return [[{"x": x + a * h, "y": y + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]


_RINGS = "array<array<struct<x:double,y:double>>>"


def test_equal_areas_are_worked_once(spark, monkeypatch):
    """areas that repeat have one context; small and large ones meet the same cells as before."""
    seen = []
    inner = A._context
    monkeypatch.setattr(A, "_context", lambda areas, *rest: seen.append(areas.count()) or inner(areas, *rest))
    grid = (1.0, 0.0, 0.0, 0.0, -1.0, 200.0)
    cells = spark.range(200 * 200).select(F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"))
    rows = [(k, *(((50.0, 50.0, 3.0), (120.0, 90.0, 60.0), (500.0, 500.0, 4.0))[k % 3])) for k in range(30)]
    areas = spark.createDataFrame([(k, _square(x, y, h)) for k, x, y, h in rows], f"k long, rings {_RINGS}")
    out = {r["k"]: r for r in A.context(areas, ["k"], (0.0, 0.0, 200.0, 200.0), (50.0, 50.0), grid, cells.where("col < 100"), cells.where("col = 130")).collect()}
    assert seen == [3] and sorted(out) == list(range(30))
    for k, x, y, h in rows:
        inside = sum(abs(c + 0.5 - x) <= h and abs(200 - r - 0.5 - y) <= h for r in range(200) for c in range(100))
        assert abs(out[k]["aoi_overlap_with_basin_fraction"] - inside / (4 * h * h)) < 1e-9
        assert out[k]["aoi_intersects_mainstem"] == (k % 3 == 1)
    found = R.inside_rings(cells, areas.where("k < 3"), grid, ["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in found} == {0: 36, 1: 14400}


def test_payloads_are_spread(spark):
    """payloads of one partition are worked in several, each object once."""
    pages = spark.range(60).coalesce(1).select(F.col("id").alias("k"), F.format_string('{"a": [{"time": "2024-01-01T00:00:00Z", "flow": %d}]}', "id").alias("payload"))
    out = P.objects(pages, keys=["k"])
    assert out.count() == 120
    assert out.where(F.spark_partition_id() >= 0).select(F.spark_partition_id().alias("n")).distinct().count() > 2
    assert P.streamflow(pages, keys=["k"]).agg(F.sum("streamflow")).first()[0] == sum(range(60))


def test_curves_are_sorted_bare(spark):
    """no sort of the look-up carries the curve's quantiles."""
    curve = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    out = H.interp(spark.range(30).select((F.col("id") % 3).alias("g"), (F.col("id") * 10.0 + 0.5).alias("q")), curve, "q", "x", "y", "v", ["g"])
    got = {(r["g"], r["q"]): r["v"] for r in out.collect()}
    assert len(got) == 30 and all(abs(v - 2 * max(q, g)) < 1e-9 for (g, q), v in got.items())
    assert _windows(out._jdf.queryExecution().optimizedPlan()) and all("__e" not in names for names in _windows(out._jdf.queryExecution().optimizedPlan()))


def _windows(plan):
    """The columns of every window in a plan."""
    kids, own = plan.children(), plan.output()
    here = [[own.apply(i).name() for i in range(own.size())]] if plan.nodeName() == "Window" else []
    return here + [w for i in range(kids.size()) for w in _windows(kids.apply(i))]


def test_reprojection_is_in_the_plan_once(spark):
    """the way to the target's system is not repeated for every point of a footprint."""
    said = []

    def there(x, y):
        said.append(1)
        return x * 2.0, y * 2.0

    cells = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    out = R.reproject(cells, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (2.0, 0.0, 0.0, 0.0, -2.0, 0.0), there, lambda x, y: (x / 2.0, y / 2.0))
    assert len(said) == 1
    assert {(r["row"], r["col"]): r["value"] for r in out.collect()} == {(k // 8, k % 8): float(k) for k in range(64)}


def test_survivors_of_a_bucket_all_meet(spark):
    """F8: of texts in one bucket of a band all pairs are compared but those whose sizes rule it out; heads alone leave most out."""
    rows = [(bytes([k]), k, [7, *(100 * k + j for j in range(1, S.BANDS))], 100) for k in range(6)] + [(bytes([9]), 9, [7, *(900 + j for j in range(1, S.BANDS))], 300)]
    live = spark.createDataFrame(rows, "node binary, fp long, bands array<long>, size long")
    pairs = {(bytes(r.a)[0], bytes(r.b)[0]) for r in S.bucket_pairs(live).collect()}
    assert pairs == {(i, j) for i in range(6) for j in range(6) if i < j}
    assert len(S.band_pairs(live).collect()) < len(pairs)
    same = spark.createDataFrame([(bytes([k]), 5, [100 * k + j for j in range(S.BANDS)], 50) for k in range(3)], live.schema)
    assert S.bucket_pairs(same).count() == 3


def test_a_large_bucket_lists_few_of_its_pairs(spark):
    """Pipeline: 400 variants of a text in one bucket list few of their 79,800 pairs, and lose none that reaches the similarity."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(400):
        words = list(texts[-1].split()) if k % 8 == 7 else list(base)
        for at in rng.sample(range(150), 1 if k % 8 == 7 else 10):
            words[at] = f"new{rng.randrange(300)}"
        texts.append(" ".join(words))
    near = {(i, j) for i in range(400) for j in range(i + 1, 400) if S.jaccard(texts[i], texts[j]) >= S.LEAST_JACCARD}
    rows = spark.createDataFrame([(k.to_bytes(2, "big"), t) for k, t in enumerate(texts)], "node binary, text string")
    rare = S.rarest(rows, S.slot_counts(rows)).cache()

    def listed(pairs):
        return {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in pairs.collect()}

    pairs = listed(S.rare_pairs(rare))
    assert len(near) >= 50 and near <= pairs and len(pairs) < 8000
    fresh = rows.where("hex(node) < '0040'")
    assert listed(S.rare_pairs(rare, fresh)) == {p for p in pairs if p[0] < 64}


def test_what_stays_in_a_crowded_bucket_is_near_nothing(spark, monkeypatch):
    """Pipeline: with heads left out, texts of large buckets and those that come back are all compared."""
    monkeypatch.setattr(S, "FEW", 2)
    monkeypatch.setattr(S, "MANY", 10)
    rng = random.Random(32)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(120):
        words = list(rng.choice(texts).split()) if texts and rng.random() < 0.6 else list(base)
        for at in rng.sample(range(120), 3):
            words[at] = f"new{rng.randrange(200)}"
        texts.append(" ".join(words))
    stay = [r.doc_id for r in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    order = sorted(range(len(texts)), key=lambda k: S.digest(texts[k]))
    want: list[int] = []
    for k in order:
        if all(S.jaccard(texts[k], texts[i]) < S.LEAST_JACCARD for i in want):
            want.append(k)
    assert 10 < len(want) < 110 and sorted(stay) == sorted(want)


def test_all_training_texts_teach_the_weights(spark):
    """each training text is in the sums once, with the counts of the other parts; rows of any checksum teach."""
    rows = [(k, f"the river rose {'high' if k % 3 else 'low'} at mile {k % 7}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {bytes(r.word): r.c for r in C.word_counts(docs).collect()}
    coder = C.Coder([(w, c) for w, c in counts.items() if w], 0, 90)
    coded = C.coded_texts(docs, coder, {}).cache()
    others, whole = C.slot_counts(coded, coder)
    texts = [(r.rest % C.PARTS, coder.coded(C.tokens(t))) for r, (_, t) in zip(sorted(coded.select("doc_id", "rest").collect()), rows)]
    assert {p for p, _ in texts} == set(range(C.PARTS))
    want, bits = np.zeros((C.GATES, C.INPUTS)), 0
    mixer, size = C.Mixer(coder, others), 1 << C.SLOT_BITS
    plain = lambda some: C.packed(*[sum((np.bincount(s[b == v], minlength=size) for ids in some for _, _, b, ss in [coder.events(ids, np.array([len(ids)]))] for s in ss), np.zeros(size, int)) for v in (0, 1)])
    assert (whole == plain([ids for _, ids in texts])).all()
    for part in range(C.PARTS):
        table = plain([ids for p, ids in texts if p != part])
        assert (others[part * size : (part + 1) * size] == table).all()
        for ids in (ids for p, ids in texts if p == part):
            _, node, bit, slots = coder.events(ids, np.array([len(ids)]))
            x, gate = C.Mixer(coder, table).inputs(node, slots)
            err = bit - 1 / (1 + np.exp(-(0.35 * np.stack(x)).sum(0).clip(-8, 8)))
            bits += len(bit)
            for k in range(C.INPUTS):
                want[:, k] += np.bincount(gate, err * x[k], C.GATES)
    got = C._summed(coded, mixer, C._newton, (C.GATES, C.INPUTS, C.INPUTS + 1))
    assert np.allclose(got[:, :, C.INPUTS], want, atol=1e-3)
    assert C._summed(coded, mixer, C._knots, (2, C.KNOTS))[1].sum() == pytest.approx(bits)


def test_equal_names_are_looked_for_once(spark, monkeypatch):
    """names meet tiles as different bare names, by merging; all three tiers as a plain program has them."""
    seen, inner = [], M.rarest
    monkeypatch.setattr(M, "rarest", lambda pieces, others, by: seen.append(pieces.select(by).distinct().count()) or inner(pieces, others, by))
    rng = random.Random(18)
    name = lambda: rng.choice(["Tile", "dem_", "x", "", "usgs"]) + rng.choice(["", "0012", "00120", "77", "river7"]) + rng.choice(["", "_b", "-Final", "north"])
    tiles = [(f"k{k}", name() + rng.choice([".tif", ".tiff", ""])) for k in range(60)] + [("k1", "other_river7_tile"), ("k70", "abc"), ("k71", "zz1")]
    asked = [(k, [rng.choice(["p/q/", ""]) + name() + rng.choice(["", ".tif", "_draft", "zz1"]) for _ in range(k % 3)]) for k in range(150)] + [(k, ["usgs_tile_0012_north_9"]) for k in range(200, 260)] + [(300, None), (301, ["xxabcxx", "dem0012"])]
    out = M.match_tiles(spark.createDataFrame(asked, "id long, values array<string>"), spark.createDataFrame(tiles, "key string, name string"))
    got = {r.id: r.tile for r in out.collect()}
    bare = lambda x: re.sub("[^a-z0-9]+", "", re.sub("preliminary|final|draft", "", re.sub(r"\.(tif|tiff|las|laz|shp)$", "", x.strip().split("/")[-1].lower())))

    def plain(values):
        for v in values:
            for end in ("", ".tif", ".tiff"):
                if same := [k for k, n in tiles if n.lower() == v.strip().split("/")[-1].lower() + end]:
                    return max(same)
        for v in values:
            same = [k for k, n in tiles if bare(n) == bare(v)]
            if len(bare(v)) >= 5 and len(same) == 1:
                return same[0]
        for v in values:
            same = {k for k, n in tiles if bare(n) and (bare(n) in bare(v) or bare(v) in bare(n))}
            if len(bare(v)) >= 6 and len(same) == 1:
                return same.pop()

    assert got == {i: plain(v or []) for i, v in asked} and len({v for v in got.values()}) > 10
    wanted = {bare(v) for _, vs in asked for v in vs or []}
    assert max(seen) <= max(len(wanted), len({bare(n) for _, n in tiles}))
    join = M.match_tiles(spark.createDataFrame(asked, "id long, values array<string>"), spark.createDataFrame(tiles, "key string, name string"))
    assert _nodes(join._jdf.queryExecution().sparkPlan()).count("BroadcastHashJoin") <= 1  # of the answers with their rows


def test_equal_tokens_in_equal_contexts_are_worked_once(monkeypatch):
    """op12_context_mixing: what a task finds again is counted, by part and leaves before it, and nothing is lost."""
    monkeypatch.setattr(C, "BITS_OF_AT_ONCE", 7)
    coder = C.Coder([(f"w{k}".encode(), 5 + k) for k in range(9)], 3, 40)
    rng = random.Random(6)
    texts = [coder.coded(C.tokens(" ".join(f"w{rng.randrange(11) if k % 4 else j % 5}" for j in range(k % 30)))) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([k % 12 for k in range(200)], pa.int32()), pa.array([x.tobytes() for x in texts])], names=["rest", "ids"])
    want = collections.Counter()
    for k, ids in enumerate(texts):
        before = [coder.start] * C.ORDERS + ids.tolist()
        want.update((k % C.PARTS, *before[j : j + C.ORDERS + 1]) for j in range(len(ids)))
    met = list(C._met([batch], coder))
    got = [(int(p), *(int(x) for x in (*reversed(w), i)), int(n)) for part, times, ids, lasts in met for p, n, i, *w in zip(part, times, ids, *lasts)]
    assert len(got) == len(want) < 0.8 * sum(want.values()) and max(len(x[0]) for x in met) == 7
    assert {g[:-1]: g[-1] for g in got} == want
    ends = np.cumsum([len(x) for x in texts])
    plain = np.bincount(np.concatenate(coder.events(np.concatenate(texts), ends)[3]), minlength=1 << C.SLOT_BITS)
    worked = sum(np.bincount(at, times[place], 1 << C.SLOT_BITS) for _, times, ids, lasts in met for place, _, _, slots in [coder.bits(ids, lasts)] for at in slots)
    assert (plain == worked).all()


def _nodes(plan):
    kids = plan.children()
    return [plan.nodeName()] + [n for i in range(kids.size()) for n in _nodes(kids.apply(i))]


def test_cells_do_not_meet_all_sections(spark):
    """the nearest section, ties and ends of the reach included, without a join of cells and sections."""
    grid = (2.0, 0.0, 0.0, 0.0, -3.0, 0.0)
    cells = spark.range(70 * 90).select(F.floor(F.col("id") / 90).cast("int").alias("row"), (F.col("id") % 90).cast("int").alias("col"), F.col("id").alias("own"))
    for places in ([(k, 3 * k % 70, 40) for k in range(60)] + [(99, 6, 40)], [(k, 7 * k % 70, 11 * k % 90) for k in range(25)], [(k, 30, 4 * k) for k in range(20)]):
        sections = spark.createDataFrame([(k, c * 2.0 + 1.0, -3.0 * r - 1.5, f"w{k}") for k, r, c in places], "section_id long, x double, y double, wse string")
        out = R.nearest_section(cells, sections, grid, 24.0)
        assert out.columns == ["row", "col", "own", "section_id", "wse", "distance_m"] and "Join" not in _nodes(out._jdf.queryExecution().optimizedPlan())
        last = {}
        for k, r, c in sorted(places):
            last[r, c] = k
        got = out.collect()
        assert len(got) == 70 * 90
        for g in got:
            d2, r, c = min((((g.row - r) * 3.0) ** 2 + ((g.col - c) * 2.0) ** 2, r, c) for r, c in last)
            k = last[r, c]
            assert (g.section_id, g.wse, g.distance_m) == ((k, f"w{k}", d2**0.5) if d2 <= 24.0**2 else (None, None, None))
    none = R.nearest_section(cells.limit(5), sections.limit(0), grid, 24.0).collect()
    assert len(none) == 5 and all(r.section_id is None and r.distance_m is None for r in none)


def test_corridor_is_spread(spark):
    """shapes that come from one window are dealt to several tasks, and cells meet edges without a lambda."""
    ring = lambda k: [{"x": k + a, "y": b - 3.0} for a, b in ((0.2, 0.4), (1.6, 0.7), (1.5, 2.2), (0.2, 0.4))]
    shapes = spark.createDataFrame([([ring(float(k))],) for k in range(40)], f"rings {_RINGS}").coalesce(1)
    out = G.cells_near_rings(shapes, R.UNIT_GRID, 6, 50, 0.25)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert any(n.startswith("Repartition") for n in _nodes(plan)) and "exists(" not in plan.toString()
    got = {(r.row, r.col) for r in out.collect()}

    def gap(r, c, ring):
        """Distance between a cell's square and a triangle, by points on both borders and their insides."""
        from itertools import pairwise

        steps = [i / 40 for i in range(41)]
        edge = [(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])) for p, q in pairwise(ring) for t in steps]
        return min((max(c - x, 0.0, x - c - 1) ** 2 + max(-r - 1 - y, 0.0, y + r) ** 2) ** 0.5 for x, y in edge)

    near = {(r, c): min(gap(r, c, ring(float(k))) for k in range(max(0, c - 3), min(40, c + 3)) or [39]) for r in range(6) for c in range(44)}
    assert all(((r, c) in got) == (d <= 0.25) for (r, c), d in near.items() if abs(d - 0.25) > 0.02) and len(got) > 40


def test_long_sides_go_to_few_tiles(spark, monkeypatch):
    """tiles are as wide as sides are long, and a lens meets bare ends, not points, before it brings its own."""
    asked = []
    inner = Si._conflicts
    monkeypatch.setattr(Si, "_conflicts", lambda arcs, tile: asked.append((tile, inner(arcs, tile))) or asked[-1][1])
    line = lambda k: [{"x": 100.0 * i, "y": 500.0 * k + (30.0 if i % 2 else 0.0)} for i in range(9)]
    strip = lambda k: [[*line(k), *line(k + 1)[::-1], line(k)[0]]]
    shapes = spark.createDataFrame([(k, strip(k)) for k in range(6)], f"k long, rings {_RINGS}")
    out = {r["k"]: r["rings"] for r in Si.simplified(shapes, 5.0, ["k"]).collect()}
    assert sorted(out) == list(range(6)) and all(len(r[0]) == 19 for r in out.values())
    assert 100.0 <= asked[0][0] <= 1000.0
    thin = {r["k"]: r["rings"] for r in Si.simplified(shapes, 40.0, ["k"]).collect()}
    assert all(len(thin[k][0]) == 5 for k in range(5))  # the topmost line bends outwards
    plan = asked[-1][1]._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "sha2" not in plan


def test_tiles_of_costs_are_spread(spark):
    """small tables of tiles are not broadcast, so tiles are solved in all tasks."""
    cells = spark.range(64 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.lit(0.0).alias("value"))
    out = T.cost_distance(cells, cells.where("row = 0 and col = 0"), tile=16)
    assert out.where("cost = row + col").count() == 64 * 64
    assert out.select(F.spark_partition_id().alias("n")).distinct().count() > 2
