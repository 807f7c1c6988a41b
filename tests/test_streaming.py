"""Streams give what the same rows give as a table."""

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import series as S
from hydrospark.streaming import refresh as R


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """Events as three deliveries, the last with corrections."""
    path = tmp_path_factory.mktemp("landed")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("flow_cfs"), F.col("event_id").alias("seq"))
    mid = e.agg(F.expr("percentile_approx(time, 0.5)")).first()[0]
    for k, part in enumerate((e.where(F.col("time") < mid), e.where(F.col("time") >= mid))):
        part.coalesce(1).write.mode("append").parquet(str(path / "in"))
    return e, str(path / "in"), path


def test_running_excess_is_the_batch_integral(spark, landed):
    e, path, tmp = landed
    q = R.running_excess(R.readings(spark, path, files_per_trigger=1), 60.0, 12.0).writeStream.outputMode("update").format("memory").queryName("excess").option("checkpointLocation", str(tmp / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    last = {r.series_id: r for r in spark.sql("SELECT max_by(struct(*), point_count) AS r FROM excess GROUP BY series_id").select("r.*").collect()}
    want = {r.series_id: r for r in S.excess_volume(e.drop("seq"), 60.0, max_gap_hours=12.0).collect()}
    assert set(last) == set(want)
    for k, r in want.items():
        assert last[k].excess_volume_m3 == pytest.approx(r.excess_volume_m3) and last[k].intervals_used == r.intervals_used and last[k].intervals_skipped_large_gap == r.intervals_skipped_large_gap


@pytest.mark.parametrize("look_back", [1e9, 24.0 * 12])
def test_corrections_change_the_running_volume(spark, landed, tmp_path, look_back):
    """Readings in no order, late ones and corrections: what is summed at the end is the batch integral of the last words."""
    e, _, _ = landed
    hours = e.withColumn("h", F.floor(F.unix_timestamp("time") / 3600 / 24 / 9))  # deliveries of nine days
    days = [r.h for r in hours.select("h").distinct().orderBy("h").collect()]
    path = str(tmp_path / "in")
    for h in days:
        part = hours.where(F.col("h") == h).drop("h")
        late = part.where("seq % 7 = 0")
        wrong = part.where("seq % 5 = 0").withColumns({"seq": F.col("seq") - 1_000_000, "flow_cfs": F.col("flow_cfs") + 500.0})
        part.where("seq % 7 <> 0").unionByName(wrong).orderBy(F.desc("time")).coalesce(1).write.mode("append").parquet(path)
        late.coalesce(1).write.mode("append").parquet(path)
    q = R.corrected_excess(R.readings(spark, path, files_per_trigger=1), 60.0, look_back, 12.0).writeStream.outputMode("update").format("memory").queryName(f"corrected{int(look_back)}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.series_id: r for r in spark.sql(f"SELECT max_by(struct(*), struct(point_count, corrected_readings)) AS r FROM corrected{int(look_back)} GROUP BY series_id").select("r.*").collect()}
    want = {r.series_id: r for r in S.excess_volume(e.drop("seq"), 60.0, max_gap_hours=12.0).collect()}
    assert set(got) == set(want) and sum(r.corrected_readings for r in got.values()) > 0
    for k, r in want.items():
        assert got[k].late_readings == 0
        assert got[k].excess_volume_m3 == pytest.approx(r.excess_volume_m3) and got[k].intervals_used == r.intervals_used and got[k].intervals_skipped_large_gap == r.intervals_skipped_large_gap


def test_upserts_keep_the_last_word(spark, landed):
    e, path, tmp = landed
    fixed = e.where("seq % 5 = 0").withColumns({"seq": F.col("seq") + 1_000_000, "flow_cfs": F.col("flow_cfs") + 1.0})
    fixed.coalesce(1).write.mode("append").parquet(path.replace("/in", "/in2"))
    e.coalesce(1).write.mode("append").parquet(path.replace("/in", "/in2"))
    out = str(tmp / "table")
    R.upsert_into(R.readings(spark, path.replace("/in", "/in2"), files_per_trigger=1), out, str(tmp / "c2")).awaitTermination(240)
    got = {(r.series_id, r.time): r.flow_cfs for r in spark.read.parquet(out).collect()}
    assert got == {(r.series_id, r.time): r.flow_cfs + (1.0 if r.seq % 5 == 0 else 0.0) for r in e.collect()}


def test_windows_and_alerts(spark, landed):
    e, path, tmp = landed
    q = R.windowed(R.readings(spark, path), "1 day").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == e.count()
    limits = e.select("series_id").distinct().withColumn("threshold_cfs", F.lit(100.0))
    q = R.alerts(R.readings(spark, path), limits).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp / "c4")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("alerts").count() == e.where("flow_cfs >= 100").count()
