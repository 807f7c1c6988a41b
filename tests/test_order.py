"""Order statistics of large groups against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import order as O

WANTED = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "two", "tail"])
def test_a_zone_of_all_rows(spark, kind):
    rng = np.random.default_rng(5)
    n = 30_001
    v = {"spread": rng.normal(size=n), "ties": rng.integers(0, 7, n).astype(float), "one": np.full(n, 3.5), "two": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)), "tail": np.exp(rng.normal(0, 9, n))}[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").withColumn("z", F.lit("all")).repartition(8)
    got = O.percentiles(df, "v", WANTED, ["z"], large=300).collect()
    assert len(got) == 1 and got[0].z == "all"
    for name, q in WANTED.items():
        assert got[0][name] == pytest.approx(np.quantile(v, q), rel=1e-12), name
    assert O.percentiles(df, "v", {"m": 0.5}, large=300).first().m == pytest.approx(np.median(v), rel=1e-12)


def test_large_and_small_groups_nulls_and_no_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(None, float(x)) for x in rng.random(2000)] + [("a", float(x)) for x in rng.random(1500)] + [("b", 2.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "z string, v double")
    got = {r.z: r.p50 for r in O.percentiles(df, "v", {"p50": 0.5}, ["z"], large=100).collect()}
    for z in (None, "a", "b"):
        assert got[z] == pytest.approx(np.median([v for k, v in rows if k == z and v is not None]))
    assert got.get("c") is None
    assert O.percentiles(df.where("z = 'x'"), "v", WANTED, ["z"]).count() == 0


def test_no_plan_gathers_a_large_group(spark):
    """Between its rounds a large group meets sketches, counts and a bounded rest, never the buffer of all values."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"))
    plan = O.percentiles(df, "v", {"p": 0.5}, large=200)._jdf.queryExecution().toString()
    assert " percentile(" not in plan
