"""History of a table: its rows plus ``snapshot_timestamp``, one partition per snapshot."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.publish import HISTORY

STAMP = "snapshot_timestamp"
KEY = "snapshot_key"
_KEY_FORMAT = "%Y%m%dT%H%M%S"


class SnapshotSchemaError(Exception):
    """The live table and its history have different columns."""


def snapshot_key(epoch: int) -> str:
    """The partition value of a snapshot; keys sort as their times do."""
    return datetime.fromtimestamp(epoch, UTC).strftime(_KEY_FORMAT)


def _epoch(key: str) -> int:
    return int(datetime.strptime(key, _KEY_FORMAT).replace(tzinfo=UTC).timestamp())


def _keys(spark: SparkSession, history: str) -> DataFrame:
    """Snapshot keys from the catalog alone; no data is read."""
    listed = spark.sql(f"SHOW PARTITIONS {history}")
    return listed.select(F.split_part("partition", F.lit("="), F.lit(2)).alias("key"))


def snapshot_dates(spark: SparkSession, name: str) -> tuple[int | None, int | None]:
    """Epochs of the newest and the oldest snapshot, or two Nones."""
    history = name + HISTORY
    if not spark.catalog.tableExists(history):
        return None, None
    newest, oldest = _keys(spark, history).agg(F.max("key"), F.min("key")).first()
    return (_epoch(newest), _epoch(oldest)) if newest else (None, None)


def stamped(live: DataFrame, now: int) -> DataFrame:
    return live.withColumn(STAMP, F.timestamp_seconds(F.lit(now)))


def create_history(spark: SparkSession, name: str, now: int) -> None:
    """An empty history with the live table's columns."""
    empty = stamped(spark.table(name), now).withColumn(KEY, F.lit("")).limit(0)
    empty.write.partitionBy(KEY).format("parquet").saveAsTable(name + HISTORY)


def column_drift(spark: SparkSession, name: str) -> tuple[dict, dict]:
    """Columns (name to type) that only the live table has, and that only the history has."""
    live = {f.name: f.dataType.simpleString() for f in spark.table(name).schema}
    kept = {
        f.name: f.dataType.simpleString()
        for f in spark.table(name + HISTORY).schema
        if f.name not in (STAMP, KEY)
    }
    return dict(live.items() - kept.items()), dict(kept.items() - live.items())


def append_snapshot(spark: SparkSession, name: str, now: int, allow_missing: bool = False) -> None:
    """Add the live rows as the snapshot of ``now``; doing it again replaces that snapshot.

    If columns differ, this is an error unless ``allow_missing``: then the history
    gets the live table's new columns, and either side reads NULL where it has none.
    """
    history, key = name + HISTORY, snapshot_key(now)
    rows = stamped(spark.table(name), now).withColumn(KEY, F.lit(key))
    added, gone = column_drift(spark, name)
    # A column whose type changed is in both; it cannot be brought together.
    if (added or gone) and (not allow_missing or added.keys() & gone.keys()):
        raise SnapshotSchemaError(f"{name}: only live {added}, only in history {gone}")
    if added:
        listed = ", ".join(f"`{column}` {kind}" for column, kind in added.items())
        spark.sql(f"ALTER TABLE {history} ADD COLUMNS ({listed})")
    spark.sql(f"ALTER TABLE {history} DROP IF EXISTS PARTITION ({KEY}='{key}')")
    columns = spark.table(history).columns
    missing = [c for c in columns if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None) for c in missing}).select(*columns)
    rows.write.mode("append").partitionBy(KEY).format("parquet").saveAsTable(history)


def prune_snapshots(spark: SparkSession, name: str, now: int, keep_minutes: int) -> int:
    """Drop snapshots older than the retention; returns how many went.

    Dropping partitions touches expired files only.
    """
    history, oldest_kept = name + HISTORY, snapshot_key(now - keep_minutes * 60)
    expired = _keys(spark, history).where(F.col("key") < oldest_kept)
    dropped = 0
    for row in expired.toLocalIterator():
        spark.sql(f"ALTER TABLE {history} DROP IF EXISTS PARTITION ({KEY}='{row.key}')")
        dropped += 1
    return dropped


def make_snapshot(
    spark: SparkSession,
    name: str,
    now: int,
    interval_minutes: int,
    keep_minutes: int | None = None,
    allow_missing: bool = False,
) -> bool:
    """Snapshot the live table if the newest one is older than the interval, then prune.

    Without a retention all snapshots are kept.  Returns whether one was added.
    """
    newest, _ = snapshot_dates(spark, name)
    if newest is None and not spark.catalog.tableExists(name + HISTORY):
        create_history(spark, name, now)
    due = newest is None or now - newest > interval_minutes * 60
    if due:
        append_snapshot(spark, name, now, allow_missing)
    if keep_minutes is not None:
        prune_snapshots(spark, name, now, keep_minutes)
    return due


def read_history(spark: SparkSession, name: str) -> DataFrame:
    """All snapshots: the live columns and ``snapshot_timestamp``."""
    return spark.table(name + HISTORY).drop(KEY)
