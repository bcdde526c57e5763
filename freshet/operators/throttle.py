"""Swallow repeats of an event until a time has passed since the last one let through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions.times import epoch_micros, floor_units
from freshet.session import stage

DEFAULT_SECONDS = 600


def _slots(stamps: DataFrame, hold: int) -> DataFrame:
    """One row per key and slot of the hold time.

    ``follows``: the slot before holds stamps.  ``starts``: the first stamp comes
    after a pause of the hold time or more, so it is let through in any case.
    ``later``: the first stamp of the next slot, unless that one starts.
    """
    by_slot = Window.partitionBy("key").orderBy("slot")
    pause = F.col("first") - F.lag("last").over(by_slot)
    return (
        stamps.groupBy("key", "slot")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .withColumn("follows", F.coalesce(F.lag("slot").over(by_slot) == F.col("slot") - 1, F.lit(False)))
        .withColumn("starts", F.coalesce(pause >= hold, F.lit(True)))
        .withColumn("later", F.when(~F.lead("starts").over(by_slot), F.lead("first").over(by_slot)))
        .drop("last")
    )


def _jumps(stamps: DataFrame, slots: DataFrame, hold: int) -> DataFrame:
    """``(key, src, dst)``: if ``src`` is let through, ``dst`` is next; none if the next one starts.

    What follows a stamp is the first one from ``at + hold`` on.  It lies in the next
    slot or is the first of the slot after that; further on it comes after a pause
    and starts.  So each stamp looks into the next slot, and no window over stamps
    spans more than a slot of a key.
    """

    def probe(slot: Column, from_at: Column, src: Column) -> Column:
        return F.struct(slot.alias("slot"), from_at.alias("from_at"), src.alias("src"))

    mark = probe(F.col("slot"), F.col("at"), F.lit(None).cast("bigint"))
    look = probe(F.col("slot") + 1, F.col("at") + hold, F.col("at"))
    from_there_on = (
        Window.partitionBy("key", "slot")
        .orderBy(F.col("from_at").desc(), F.col("src").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.min(F.when(F.col("src").isNull(), F.col("from_at"))).over(from_there_on)
    return (
        stamps.select("key", F.inline(F.array(mark, look)))
        .join(slots, ["key", "slot"])
        .where("src IS NOT NULL OR follows")
        .withColumn("dst", F.coalesce(found, "later"))
        .where("src IS NOT NULL AND dst IS NOT NULL AND NOT (starts AND dst = first)")
        .select("key", "src", "dst")
    )


def _chained(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """The stamps that chains of jumps from ``starts`` lead to, without the starts.

    Jumps are doubled until none is left, each time only from stamps that jumps of
    the same size lead to; then chains are filled in from the longest jumps down.
    The rounds grow with the logarithm of the longest chain.
    """
    jumps, n = stage(jumps)
    origins, _ = stage(
        starts.join(jumps.withColumnRenamed("src", "at"), ["key", "at"], "left_semi")
    )
    levels = []
    while n:
        levels.append(jumps)
        landed = jumps.select("key", F.col("dst").alias("src"))
        reached = origins.withColumnRenamed("at", "src").unionByName(landed).distinct()
        first = jumps.join(reached, ["key", "src"], "left_semi")
        second = jumps.select("key", F.col("src").alias("dst"), F.col("dst").alias("end"))
        doubled = first.join(second, ["key", "dst"])
        jumps, n = stage(doubled.select("key", "src", F.col("end").alias("dst")))
    chained = origins.withColumn("chained", F.lit(False))
    for jumps in reversed(levels):
        # Different stamps of a chain jump to different ones: nothing comes up twice.
        onward = F.when(F.col("dst").isNotNull(), F.struct(F.col("dst").alias("at"), F.lit(True).alias("chained")))
        chained = chained.join(jumps.withColumnRenamed("src", "at"), ["key", "at"], "left").select(
            "key", F.inline(F.array_compact(F.array(F.struct("at", "chained"), onward)))
        )
    return chained.where("chained").select("key", "at")


def throttle(
    events: DataFrame,
    keys: list[str],
    time: str,
    seconds: int = DEFAULT_SECONDS,
    tie_break: str | None = None,
) -> DataFrame:
    """Per key, keep an event, then swallow those less than ``seconds`` after the last kept one.

    Of events with equal key and time one is kept, the least by ``tie_break``.  An event
    without a time is after no other: all of them are kept.
    Exact to the microsecond.  A key may hold any share of the events: work is
    parted by key and time, and no task takes in a whole key.
    """
    hold = seconds * 1_000_000
    # A struct of the key values is never NULL itself, so NULL is a key like any other.
    key, at = F.struct(*keys).alias("key"), epoch_micros(events, time).alias("at")
    timed = events.where(F.col(time).isNotNull())
    stamps, _ = stage(timed.select(key, at).distinct())
    stamps = stamps.withColumn("slot", floor_units(F.col("at"), hold))
    slots, _ = stage(_slots(stamps, hold))
    starts = slots.where("starts").select("key", F.col("first").alias("at"))
    kept = starts.unionByName(_chained(starts, _jumps(stamps, slots, hold)))

    row = F.struct(*events.columns)
    order = F.col(tie_break) if tie_break else F.col("event")
    untimed = events.where(F.col(time).isNull())
    return (
        timed.select(key, at, row.alias("event"), *([tie_break] if tie_break else []))
        .join(kept, ["key", "at"], "left_semi")
        .groupBy("key", "at")
        .agg(F.min_by("event", order).alias("event"))
        .select("event.*")
        .unionByName(untimed)
    )
