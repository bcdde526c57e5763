import random

import pytest
from pyspark.sql import functions as F

from freshet.functions.times import epoch_micros
from freshet.operators.throttle import throttle
from freshet.plans import samples
from freshet.streaming.throttle import throttle_batches, throttle_stream

SF_DIR = "/root/testdata/sf0.001"


def by_hand(events, hold):
    """Events as (key, time, id): let one through, swallow the rest for the hold time."""
    last, kept = {}, set()
    for key, at, i in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in last or at - last[key] >= hold:
            last[key] = at
            kept.add(i)
    return kept


def run(spark, events, seconds):
    df = spark.createDataFrame(events, "k string, at bigint, id int").withColumn("ts", F.timestamp_micros("at"))
    return {r.id for r in throttle(df, ["k"], "ts", seconds, tie_break="id").collect()}


@pytest.mark.parametrize(
    "seconds, span, n",
    [(10, 200, 400), (10, 4000, 300), (60, 300, 300), (1, 30, 300)],
)
def test_against_brute_force(spark, seconds, span, n):
    draw = random.Random(seconds * span)
    # One key holds most events; times fall on half seconds, so many are equal or exactly apart.
    events = [
        ("hot" if draw.random() < 0.7 else draw.choice("abc"), draw.randrange(2 * span) * 500_000, i)
        for i in range(n)
    ]
    assert run(spark, events, seconds) == by_hand(events, seconds * 1_000_000)


def test_steady_events(spark):
    """One event a second: every tenth is let through."""
    events = [("k", i * 1_000_000, i) for i in range(500)]
    assert run(spark, events, 10) == set(range(0, 500, 10))


def test_null_key_and_times_before_1970(spark):
    events = [(None, -5_000_000, 1), (None, -1_000_000, 2), (None, 6_000_000, 3), ("x", -1, 4), ("x", 9_999_998, 5)]
    assert run(spark, events, 10) == by_hand(events, 10_000_000) == {1, 3, 4}


def test_one_dense_key_of_the_samples(spark):
    events = samples.table(spark, SF_DIR, "events")
    got = {r.event_id for r in throttle(events.withColumn("one", F.lit(1)), ["one"], "ts", 3600).collect()}
    rows = events.select("event_id", epoch_micros(events, "ts").alias("at")).collect()
    assert got == by_hand([(1, r.at, r.event_id) for r in rows], 3600 * 1_000_000)


def files_in_time_order(spark, folder):
    """The sample events in three files; a stream reads one per trigger."""
    events = samples.table(spark, SF_DIR, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = ["2024-01-01", "2024-01-12", "2024-01-20", "2025-01-01"]
    for part, (low, high) in enumerate(zip(days, days[1:])):
        inside = events.where((F.col("ts") >= low) & (F.col("ts") < high))
        inside.coalesce(1).write.parquet(f"{folder}/in/{part}")
    stream = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"{folder}/in")
    )
    want = throttle(events, ["user_id"], "ts", 86400, "event_id")
    return stream, sorted(tuple(r) for r in want.select("user_id", "ts").collect())


def test_stream_equals_batch(spark, tmp_path):
    stream, want = files_in_time_order(spark, tmp_path)
    running = (
        throttle_stream(stream, ["user_id"], "ts", 86400)
        .writeStream.format("memory")
        .queryName("throttled")
        .option("checkpointLocation", f"{tmp_path}/state")
        .start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(tuple(r) for r in spark.table("throttled").collect()) == want


def test_stream_by_batches_equals_batch(spark, tmp_path):
    stream, want = files_in_time_order(spark, tmp_path)

    def sink(kept, epoch):
        kept.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

    writer = throttle_batches(
        stream, ["user_id"], "ts", sink, f"{tmp_path}/last", 86400, tie_break="event_id"
    )
    running = writer.option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("epoch").distinct().count() == 3
    assert sorted(tuple(r) for r in out.select("user_id", "ts").collect()) == want
