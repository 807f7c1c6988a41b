"""Landed payloads, odd ones included."""

import json

import pytest
from pyspark.sql import functions as F

from hydrospark.functions import columns as X
from hydrospark.sources import payloads as P
from hydrospark.sources import tables as T


def pages(spark, *docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "page int, payload string")


def test_daily_values(spark):
    p = pages(spark, {"features": [{"properties": {"time": "2020-01-01", "value": "5"}}, {"properties": {"date": "2020-01-01", "value": 7}}, {"properties": {"datetime": "2020-01-02", "value": "x"}}]}, {"features": None}, "not json")
    assert [(str(r.time)[:10], r.value) for r in P.daily_values(p).collect()] == [("2020-01-01", 7.0)]


def test_next_page(spark):
    p = pages(spark, {"links": [{"rel": "self", "href": "a"}, {"rel": "next", "href": "b"}]}, {"links": []})
    assert [r.next for r in P.next_page(p).orderBy("page").collect()] == ["b", None]


def test_rating_points_of_any_nesting(spark):
    p = pages(spark, {"a": {"b": [[{"stage": 1.5, "flow": "10"}, {"stage": 1.5, "flow": 10}, {"stage": 2, "flow": -1}]], "height": 3, "discharge": 30.5}})
    assert sorted((r.stage_ft, r.flow_cfs) for r in P.rating_points(p).collect()) == [(1.5, 10.0), (3.0, 30.5)]


def test_flood_status(spark):
    p = pages(spark, {"x": [{"severity": "HIGH", "gaugeId": "g1"}, {"severity": "LOW"}, {"y": {"severity": "MID", "inundationMapSet": {}}}]})
    assert sorted(r.severity for r in P.flood_status(p).collect()) == ["HIGH", "MID"]


def test_locations(spark):
    site = lambda n, kind, lon: {"id": n, "geometry": {"coordinates": [lon, 29.5]}, "properties": {"monitoring_location_number": None, "site_type_code": kind}}
    p = pages(spark, {"features": [site("USGS-08075770", "ST", -95.3), site("USGS-1", "LK", -95.3), site("USGS-2", "ST-TS", -99.0)]})
    assert {r.site_no for r in P.monitoring_locations(p).collect()} == {"08075770", "2"}
    box = X.degree_box(F.lit(29.5), F.lit(-95.3), F.lit(30.0))
    assert [r.site_no for r in P.monitoring_locations(p, box=box).collect()] == ["08075770"]


@pytest.mark.parametrize(("doc", "want"), [({"location": {"latitude": 1.5, "longitude": 2}}, (1.5, 2.0)), ({"latLng": {"latitude": 1, "longitude": 2}}, (1.0, 2.0)), ({"latitude": 3, "longitude": 4}, (3.0, 4.0)), ({}, (None, None))])
def test_location(spark, doc, want):
    r = pages(spark, doc).select(P.location("payload").alias("l")).first()["l"]
    assert (r.lat, r.lon) == want


def test_features(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    f = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    p = pages(spark, {"features": [f("Polygon", [square], name="a"), f("MultiPolygon", [[square], [square]]), f("LineString", square[:2]), f("Point", [5, 6]), f("Polygon", []), {"type": "Feature", "geometry": None}]})
    out = P.geojson_features(p).collect()
    assert sorted((r.geom_type, len(r.rings)) for r in out) == [("LineString", 1), ("MultiPolygon", 2), ("Point", 1), ("Polygon", 1)]
    assert [r.rings[0][0].y for r in out if r.geom_type == "Point"] == [6.0]


def test_probability_and_failover(spark):
    p = pages(spark, {"properties": {"probabilityOfPrecipitation": {"values": [{"validTime": "2024-01-01T00:00:00Z/PT1H", "value": 40}, {"validTime": "bad", "value": 1}]}}})
    assert [r.probability_percent for r in P.rain_probability(p).collect()] == [40.0]
    a = spark.createDataFrame([], "x int")
    b = spark.createDataFrame([(1,)], "x int")
    assert [(r.x, r.source_rank) for r in P.first_with_rows(a, b).collect()] == [(1, 1)]
    assert P.first_with_rows(a, a).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t1.tif").write_bytes(b"12345")
    (tmp_path / "a" / "t2.txt").write_bytes(b"1")
    assert [(r.name, r.bytes) for r in T.list_files(spark, str(tmp_path)).collect()] == [("t1.tif", 5)]
    T.save_cache(spark.createDataFrame([("2020-01-01 00:00:00", 1.0), ("bad", 2.0)], "time string, v double"), str(tmp_path / "c"), "modern")
    back = T.load_cache(spark, str(tmp_path / "c")).collect()
    assert [(r.v, r.cache_source) for r in back] == [(1.0, "modern")]
    (tmp_path / "p.json").write_text('{"a": 1}')
    assert P.read_payloads(spark, str(tmp_path / "p.json")).first()["payload"] == '{"a": 1}'
