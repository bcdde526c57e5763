"""The throttle over a stream: state is the time of the last event let through, per key.

``throttle_stream`` keeps it in Spark's state store; the cost of a trigger goes
with its events.  ``throttle_batches`` keeps it in a table and runs the batch
operator on each trigger, so that no key's events have to meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

from freshet.functions.times import epoch_micros
from freshet.operators.skew import find_hot_keys, spread_join
from freshet.operators.throttle import DEFAULT_SECONDS, throttle
from freshet.session import stage


def throttle_stream(
    events: DataFrame,
    keys: list[str],
    time: str,
    seconds: int = DEFAULT_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Per key, ``(key columns..., time)`` of the events a stream lets through.

    Events without a time are all let through.  Events are put in order within a trigger.  A key's stamps of one trigger (eight
    bytes each) meet in one task, so bound a trigger at the source, for example
    with ``maxFilesPerTrigger``.  Events later than ``lateness`` are dropped; state
    goes once the watermark has passed the hold time of the last event let through.
    """
    if isinstance(events.schema[time].dataType, TimestampNTZType):
        # Watermarks need a point in time; a time without a zone is taken as UTC.
        instant = F.from_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone())
        events = events.withColumn(time, instant)
    hold = seconds * 1_000_000
    key_types = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([b["_at"] for b in batches])
        untimed = int(times.isna().sum())
        if untimed:
            yield pd.DataFrame({**dict(zip(keys, key)), "_at": pd.array([None] * untimed, "Int64")})
        stamps = np.unique(times.dropna().to_numpy("int64"))
        if not len(stamps):
            return
        before = state.get[0] if state.exists else None
        kept, last = [], before
        while True:
            at = 0 if last is None else int(np.searchsorted(stamps, last + hold, "left"))
            if at >= len(stamps):
                break
            last = int(stamps[at])
            kept.append(last)
        state.update((last,))
        # A stamp from last + hold on is let through whatever the state says.
        state.setTimeoutTimestamp(max((last + hold) // 1000, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({**dict(zip(keys, key)), "_at": kept})

    return (
        events.withWatermark(time, lateness)
        .select(*keys, time, F.unix_micros(time).alias("_at"))
        .groupBy(*keys)
        .applyInPandasWithState(
            step,
            outputStructType=f"{key_types}, _at bigint",
            stateStructType="last bigint",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
        .select(*keys, F.timestamp_micros("_at").alias(time))
    )


def throttle_batches(
    events: DataFrame,
    keys: list[str],
    time: str,
    sink: Callable[[DataFrame, int], None],
    state_dir: str,
    seconds: int = DEFAULT_SECONDS,
    lateness_seconds: int = 600,
    tie_break: str | None = None,
) -> DataStreamWriter:
    """A writer that hands the events let through in each trigger to ``sink(events, epoch)``.

    ``state_dir`` is a shared folder that gets one state table per epoch.  An epoch
    that is run again reads the state before it and gives the same result, so the
    sink should replace what it wrote for that epoch.  Times are forgotten once
    events ``lateness_seconds`` behind the newest one would be let through anyway.
    """
    hold, lateness = seconds * 1_000_000, lateness_seconds * 1_000_000
    columns = events.columns

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("_key", F.to_json(F.struct(*keys))).withColumn(
            "_at", epoch_micros(batch, time)
        )
        if epoch:
            state = spark.read.schema("_key string, _last bigint").parquet(f"{state_dir}/{epoch - 1}")
        else:
            state = spark.createDataFrame([], "_key string, _last bigint")
        # The batch may hold a hot key; the state has one row per key.
        known = spread_join(keyed, state, "_key", "left", ["_at"], find_hot_keys(keyed, "_key"))
        due = known.where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last") + hold))
        kept, _ = stage(throttle(due.select(*columns), keys, time, seconds, tie_break))
        sink(kept, epoch)
        later = kept.select(
            F.to_json(F.struct(*keys)).alias("_key"), epoch_micros(kept, time).alias("_last")
        )
        newest = keyed.agg(F.max("_at")).first()[0]
        times = state.unionByName(later).groupBy("_key").agg(F.max("_last").alias("_last"))
        if newest is not None:
            times = times.where(F.col("_last") + hold > newest - lateness)
        times.write.mode("overwrite").parquet(f"{state_dir}/{epoch}")

    return events.writeStream.foreachBatch(step)
