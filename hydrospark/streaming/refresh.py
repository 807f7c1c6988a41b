"""Live refresh as Structured Streaming.

The three-hour gap rule, upserts of corrected readings and the live run on stored terrain are parity with
polling; windows and threshold alerts are extensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydrospark.functions import constants as C
from hydrospark.operators import series as S
from hydrospark.session import ship

READING = "series_id string, time timestamp, flow_cfs double, seq long"


def readings(spark: SparkSession, path: str, schema: str = READING, files_per_trigger: int | None = None) -> DataFrame:
    """Readings that land as Parquet files."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def deduplicated(stream: DataFrame, keys: tuple[str, ...] = ("series_id", "time"), watermark: str = "7 days") -> DataFrame:
    """The look-back is delivered again and again; each reading passes once."""
    return stream.withWatermark("time", watermark).dropDuplicatesWithinWatermark(list(keys))


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("series_id", "time"), seq: str = "seq", **trigger) -> StreamingQuery:
    """Every batch is merged into the table ``path``; of equal keys the highest ``seq`` stays.

    Only the days that a batch touches are written again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("time"))
        days = [r["day"] for r in new.select("day").distinct().collect()]
        if not days:
            return
        try:
            old = spark.read.parquet(path).where(F.col("day").isin(days))
            new = S.upsert_latest(old, new, [*keys, "day"], seq)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = S.latest(new, [*keys, "day"], seq)
        staged = f"{path}__staged"
        new.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATE = "last_time double, last_excess double, volume double, used long, skipped long, peak double, points long, late long"
VOLUME = "series_id string, excess_volume_m3 double, intervals_used long, intervals_skipped_large_gap long, peak_flow_cfs double, point_count long, late_readings long"


def running_excess(stream: DataFrame, bankfull: float, max_gap_hours: float = 3.0, idle: int | None = None) -> DataFrame:
    """The excess volume of every series so far, by its last reading; an interval over the gap is not bridged.

    The state of a series is eight numbers.  Within a batch readings are sorted; one that is not after the last
    of an earlier batch is too late for the running volume and is counted in ``late_readings``: where that is
    above zero, the series is to be integrated anew from the table that ``upsert_into`` keeps.  A series without
    readings for ``idle`` milliseconds is forgotten; without it none is.
    """
    wait = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    ship(stream.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, before, volume, used, skipped, peak, n, late = state.get if state.exists else (float("nan"), 0.0, 0.0, 0, 0, float("-inf"), 0, 0)
        rows = pd.concat(list(parts)).sort_values("time")
        for t, q in zip(rows["time"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6, rows["flow_cfs"].to_numpy(float)):
            if n and t <= last:
                late += 1
                continue
            excess = max(q - bankfull, 0.0) * C.CFS_TO_CMS
            if n:
                if t - last <= max_gap_hours * 3600.0:
                    volume, used = volume + 0.5 * (before + excess) * (t - last), used + 1
                else:
                    skipped += 1
            last, before, peak, n = t, excess, max(peak, q), n + 1
        state.update((last, before, volume, used, skipped, peak, n, late))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], volume, used, skipped, peak, n, late)], columns=[p.split()[0] for p in VOLUME.split(", ")])

    return stream.where("time is not null and flow_cfs is not null").groupBy("series_id").applyInPandasWithState(step, VOLUME, STATE, "update", wait)


SEALED = "last_time double, last_excess double, volume double, used long, skipped long, peak double, points long, late long, corrected long, recent binary"
CORRECTED = VOLUME + ", corrected_readings long"


def _summed(t: np.ndarray, q: np.ndarray, bankfull: float, gap_s: float, last: float, before: float) -> tuple[float, int, int]:
    """(volume, intervals used, intervals skipped) of readings in order, the first joined to the last one before them, if any."""
    excess = np.maximum(q - bankfull, 0.0) * C.CFS_TO_CMS
    if last == last:
        t, excess = np.append(last, t), np.append(before, excess)
    step = np.diff(t)
    ok = step <= gap_s
    return float((0.5 * (excess[1:] + excess[:-1]) * step)[ok].sum()), int(ok.sum()), int((~ok).sum())


def corrected_excess(stream: DataFrame, bankfull: float, look_back_hours: float, max_gap_hours: float = 3.0, idle: int | None = None) -> DataFrame:
    """The excess volume of every series so far, where late and corrected readings change what was summed before.

    ``stream`` has ``series_id, time, flow_cfs, seq``.  The state of a series holds its readings of the last ``look_back_hours`` before
    its newest one, and sums of what is older; so a reading that arrives late within the look-back takes its place, and of two of
    one time that with the larger ``seq`` counts, as in ``upsert_into``.  Older ones are only counted, in ``late_readings``.  The
    state grows with the readings of a look-back, not with the series; without readings for ``idle`` milliseconds it is dropped.
    """
    wait = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    gap = max_gap_hours * 3600.0
    ship(stream.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, before, volume, used, skipped, peak, n, late, corrected, raw = state.get if state.exists else (float("nan"), 0.0, 0.0, 0, 0, float("-inf"), 0, 0, 0, b"")
        held = np.frombuffer(raw, "<f8").reshape(-1, 3)  # time, seq, flow
        rows = pd.concat(list(parts))
        new = np.stack([rows["time"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6, rows["seq"].to_numpy(float), rows["flow_cfs"].to_numpy(float)], axis=1)
        fresh = new[~(new[:, 0] <= last)] if last == last else new
        late += len(new) - len(fresh)
        both = np.concatenate((held, fresh))
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        keep = np.append(both[1:, 0] != both[:-1, 0], True)[: len(both)]  # the largest seq of a time stands last
        corrected += int(len(both) - keep.sum())
        both = both[keep]
        if len(both):
            old = both[:, 0] < both[-1, 0] - look_back_hours * 3600.0
            if old.any():
                v, u, k = _summed(both[old, 0], both[old, 2], bankfull, gap, last, before)
                volume, used, skipped, n = volume + v, used + u, skipped + k, n + int(old.sum())
                peak = max(peak, float(both[old, 2].max()))
                last, before = float(both[old][-1, 0]), max(float(both[old][-1, 2]) - bankfull, 0.0) * C.CFS_TO_CMS
                both = both[~old]
        state.update((last, before, volume, used, skipped, peak, n, late, corrected, both.astype("<f8").tobytes()))
        if idle is not None:
            state.setTimeoutDuration(idle)
        v, u, k = _summed(both[:, 0], both[:, 2], bankfull, gap, last, before)
        top = max(peak, float(both[:, 2].max(initial=float("-inf"))))
        yield pd.DataFrame([(key[0], volume + v, used + u, skipped + k, top, n + len(both), late, corrected)], columns=[p.split()[0] for p in CORRECTED.split(", ")])

    return stream.where("time is not null and flow_cfs is not null").groupBy("series_id").applyInPandasWithState(step, CORRECTED, SEALED, "update", wait)


def with_static(stream: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Live readings on stored tables (profiles, ratings): a stream-static join."""
    return stream.join(static, on)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run a plan on every batch; one query with its own checkpoint for each source keeps failures apart."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Extension: tumbling or sliding means and peaks of every series."""
    w = F.window("time", size, slide) if slide else F.window("time", size)
    return stream.withWatermark("time", watermark).groupBy("series_id", w.alias("w")).agg(F.count("*").alias("n"), F.avg("flow_cfs").alias("mean_cfs"), F.max("flow_cfs").alias("peak_cfs")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_cfs", "peak_cfs")


def sessions(stream: DataFrame, gap: str = "3 hours", watermark: str = "1 day") -> DataFrame:
    """Extension: runs of readings without a longer gap."""
    return stream.withWatermark("time", watermark).groupBy("series_id", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n"), F.max("flow_cfs").alias("peak_cfs")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak_cfs")


def alerts(stream: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Extension: readings at or over their series' threshold (``series_id, threshold_cfs``)."""
    return stream.join(thresholds, "series_id").where(F.col("flow_cfs") >= F.col("threshold_cfs"))
