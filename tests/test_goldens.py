"""Values worked out by hand from the formulas."""

import pytest
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.operators import banks as B
from hydrospark.operators import hydraulics as H
from hydrospark.operators import raster as R
from hydrospark.operators import series as S
from hydrospark.sources import tables as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("rain", "cn", "want"), [(11, 75, 7.813008), (11, 85, 9.133259), (11, 92, 10.021173), (0.3, 85, 0.0)])
def test_runoff(spark, rain, cn, want):
    assert value(spark, X.scs_runoff_in(F.lit(float(rain)), F.lit(float(cn)))) == pytest.approx(want, abs=1e-6)


def test_kirpich(spark):
    assert value(spark, X.kirpich_hours(F.lit(10_000.0), F.lit(0.0005))) == pytest.approx(7.279662574845)


def test_triangular_hydrograph(spark):
    row = spark.createDataFrame([(11.0, 5.0, 16.1, 85.0, 10_000.0, 0.0005, 0.0)], "rainfall_in double, duration_hours double, basin_area_sqmi double, curve_number double, mainstem_length_m double, mainstem_slope double, baseline_cfs double")
    h = H.scs_hydrograph(row).toPandas()
    assert len(h) == 75
    assert h.peak_total_cfs[0] == pytest.approx(10362.857509) and h.streamflow.max() == pytest.approx(10243.407802)
    assert h.base_time_hours[0] == pytest.approx(18.337019444902) and h.runoff_volume_m3[0] == pytest.approx(9_673_488.8657, rel=1e-9)


def series(spark, rows, cols="series_id string, time string, flow_cfs double"):
    return spark.createDataFrame(rows, cols).withColumn("time", F.to_timestamp("time"))


def test_excess_volume(spark):
    h = series(spark, [("a", "2017-08-27 00:00:00", 100.0), ("a", "2017-08-27 01:00:00", 250.0), ("a", "2017-08-27 02:00:00", 500.0)])
    r = S.excess_volume(h, 200.0).first()
    assert r.excess_volume_m3 == pytest.approx(20_388.12954624)
    assert (r.intervals_used, r.intervals_skipped_large_gap, r.exceedance_interval_hours, r.peak_flow_cfs) == (2, 0, 2.0, 500.0)
    one = S.excess_volume(h.limit(1), 200.0).first()
    assert (one.point_count, one.excess_volume_m3, one.horizon_hours) == (1, 0.0, 0.0)


def test_volume_adds_up_when_split(spark):
    rows = [("a", f"2020-01-01 {k:02d}:00:00", 50.0 * (k % 7)) for k in range(24)]
    whole = S.excess_volume(series(spark, rows), 100.0).first().excess_volume_m3
    parts = sum(S.excess_volume(series(spark, p), 100.0).first().excess_volume_m3 for p in (rows[:11], rows[10:]))
    assert whole == pytest.approx(parts)


def test_skill(spark):
    rows = [("a", f"2020-01-01 0{k}:00:00", o, m) for k, (o, m) in enumerate(((100.0, 120.0), (250.0, 240.0), (500.0, 450.0), (300.0, 330.0)))]
    r = S.hydrograph_skill(series(spark, rows, "s string, time string, observed_cfs double, modeled_cfs double"), ["s"]).first()
    for got, want in ((r.rmse_cfs, 31.224989992), (r.mae_cfs, 27.5), (r.bias_cfs, -2.5), (r.percent_bias, -0.869565217), (r.pearson_r, 0.986163822), (r.nse, 0.952366412), (r.kge, 0.844422627)):
        assert got == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize(("tolerance", "want"), [(1800, [1.0]), (1740, [])])
def test_nearest_tie_goes_to_the_earlier(spark, tolerance, want):
    left = series(spark, [("a", "2020-01-01 01:00:00", 9.0)])
    right = series(spark, [("a", "2020-01-01 00:30:00", 1.0), ("a", "2020-01-01 01:30:00", 2.0)], "series_id string, time string, q double")
    assert [r.q_nearest for r in S.asof_nearest(left, right, "q", ["series_id"], tolerance_seconds=tolerance).collect()] == want


def test_wetted_geometry(spark):
    s = spark.createDataFrame([(1, float(x), float(z)) for x, z in ((-4, 4), (-2, 2), (0, 0), (2, 2), (4, 4))], "k int, distance_m double, elevation_m double")
    r = H.wetted_geometry(s, ["k"], 3.0).first()
    assert (r.area_m2, r.top_width_m) == (10.0, 4.0)
    assert r.wetted_perimeter_m == pytest.approx(5.656854249) and r.hydraulic_radius_m == pytest.approx(1.767766953)
    assert value(spark, X.conveyance(F.lit(r.area_m2), F.lit(r.hydraulic_radius_m), F.lit(0.001))) == pytest.approx(0.462327799)
    assert H.wetted_geometry(s.limit(2), ["k"], 3.0).first().area_m2 is None


def test_rolling_median_and_fill(spark):
    from pyspark.sql import Window as W

    df = spark.createDataFrame(list(enumerate([1.0, None, 3.0, 9.0, 2.0])), "i int, x double").withColumn("g", F.lit(0))
    w = W.partitionBy("g").orderBy("i")
    rows = df.select("i", S.rolling_median("x", w, 5).alias("m"), S.fill_by_row("x", ["g"], "i").alias("f")).orderBy("i").collect()
    assert [r.m for r in rows] == [2.0, 3.0, 2.5, 3.0, 3.0]
    assert [r.f for r in rows] == [1.0, 2.0, 3.0, 9.0, 2.0]


@pytest.mark.parametrize(("n", "floor", "kept"), [(4000, True, 4000), (4001, True, 4001), (7999, True, 7999), (8000, True, 4000), (9000, True, 4500), (7999, False, 4000), (9000, False, 3000)])
def test_stride(spark, n, floor, kept):
    assert S.stride(spark.range(n).withColumn("k", F.lit(0)), ["k"], ["id"], floor=floor).count() == kept


def test_interp_is_clamped(spark):
    curve = spark.createDataFrame([(0.0, 10.0), (10.0, 20.0), (40.0, 50.0)], "x double, y double")
    p = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (25.0,), (40.0,), (99.0,), (None,)], "q double")
    got = {r.q: r.v for r in H.interp(p, curve, "q", "x", "y", "v").collect()}
    assert got == {-5.0: 10.0, 0.0: 10.0, 5.0: 15.0, 10.0: 20.0, 25.0: 35.0, 40.0: 50.0, 99.0: 50.0, None: None}


def test_extent_scores(spark):
    codes = spark.createDataFrame([(c,) for c, n in ((1, 30), (2, 10), (3, 20)) for _ in range(n)], "code int")
    r = R.extent_scores(codes).first()
    assert (round(r.precision, 9), round(r.recall, 9), round(r.csi, 9)) == (0.75, 0.6, 0.5)


def test_flow_directions_of_the_grid(spark):
    from hydrospark.queries.raster_queries import flow_direction

    got = {r.direction: r["count"] for r in flow_direction(spark, "/root/testdata/sf0.01").groupBy("direction").count().collect()}
    assert got == {-1: 3629, 0: 2440, 1: 4789, 2: 2405, 3: 4581, 4: 4666, 5: 2342, 6: 4745, 7: 2403}


def test_utm_of_a_known_point(spark):
    u = value(spark, X.to_utm(F.lit(-93.0), F.lit(0.0)))
    assert (round(u.x, 6), round(u.y, 6)) == (500_000.0, 0.0)
    v = value(spark, X.to_utm(F.lit(-95.28), F.lit(29.79)))
    assert 279_000 < v.x < 280_500 and 3_297_000 < v.y < 3_299_500


def test_peaks():
    import numpy as np

    y = np.array([0, 1, 0, 0, 3, 3, 0, 2, 2.1, 2, 0, 5.0])
    assert B.peaks(y, 0.35, 1).tolist() == [1, 4, 8]
    assert B.peaks(y, 0.35, 3).tolist() == [1, 4, 8]
    assert B.peaks(y, 2.5, 1).tolist() == [4]


def test_names(spark):
    assert value(spark, X.slugify(F.lit("  White Oak -- Bayou!  "))) == "white_oak_bayou"
    assert value(spark, X.waterway_name(F.lit("Brays Creek at Houston, TX"))) == "brays ck"
    assert value(spark, X.tile_key(F.lit("a/b/USGS_Tile_01_Final.TIF"))) == "usgstile01"
    assert value(spark, X.iso_seconds(F.lit("P1DT2H3M4.5S"))) == 93_784.5
    assert value(spark, X.iso_seconds(F.lit("1 day"))) == 0.0
    assert value(spark, X.same_waterway(F.lit(""), F.lit("Buffalo Bayou"))) is False


def test_tables_in_and_out(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c) if r else -9999.0) for r in range(4) for c in range(5)], "row int, col int, value double")
    T.write_cells(cells, str(tmp_path / "r"), tile=2)
    back = T.read_cells(spark, str(tmp_path / "r"), rows=(1, 2), tile=2)
    assert sorted((x.row, x.col, x.value) for x in back.collect()) == [(r, c, float(r * 10 + c)) for r in (1, 2) for c in range(5)]
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
    f = spark.createDataFrame([(1, ring)], "id int, rings array<array<struct<x: double, y: double>>>").select(T.feature("Polygon", "rings", ["id"]).alias("feature"))
    import json

    doc = json.loads(T.feature_collection(f))
    assert doc["features"][0]["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    assert json.loads(T.feature_collection(f.where("false")))["features"] == []
    assert T.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert T.Workspace("/w", "My Bayou!").path("levels") == "/w/workspace=my_bayou/levels"
    (tmp_path / "h.csv").write_text("time,flow_cfs\n2017-08-27T00:00:00Z,100\n2017-08-27T01:00:00Z,bad\n")
    assert [r.flow_cfs for r in T.read_csv(spark, str(tmp_path / "h.csv"), T.HYDROGRAPH).collect()] == [100.0, None]
