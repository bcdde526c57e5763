"""The catalog of definitions: changes between two sets, flags, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.times import DAY, whole_units
from freshet.operators.skew import name_lines

CATALOG_SCHEMA = (
    "table_name string, query string, interval int, config string, last_created bigint, "
    "mean double, times_run int, force int, started bigint, deleted bigint, waiting bigint"
)

_COMPARED = ("query", "interval", "config")


def is_deleted() -> Column:
    """A deletion time of 0 counts as live, like NULL."""
    return F.coalesce(F.col("deleted"), F.lit(0)) != 0


def _compare(catalog: DataFrame, definitions: DataFrame) -> DataFrame:
    """Both sides side by side with a ``status``; one row per table name in either."""
    old = catalog.select("table_name", F.struct("*").alias("old"))
    new = definitions.select("table_name", F.struct(*_COMPARED).alias("new"))
    same = F.lit(True)
    for column in _COMPARED:
        same = same & F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))
    was_deleted = F.coalesce(F.col("old.deleted"), F.lit(0)) != 0
    status = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull() & was_deleted, "gone")
        .when(F.col("new").isNull(), "deleted")
        .when(~same, "updated")
        .when(was_deleted, "revived")
        .otherwise("unchanged")
    )
    return old.join(new, "table_name", "full_outer").withColumn("status", status)


def definition_diff(catalog: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(table_name, status)``: new, updated, unchanged, deleted, revived or gone.

    Gone tables were deleted before; revived ones were too, and are back unchanged.
    """
    return _compare(catalog, definitions).select("table_name", "status")


def apply_definitions(catalog: DataFrame, definitions: DataFrame, now: int) -> DataFrame:
    """The catalog after taking in a definition set.

    New, updated and revived tables are forced.  Tables without a definition get a
    deletion time and lose their flags; an earlier deletion time stays.
    """
    both = _compare(catalog, definitions)
    status = F.col("status")
    forced, dropped = status.isin("new", "updated", "revived"), status == "deleted"

    def flag(name: str, kind: str) -> Column:
        return F.when(~dropped, F.col(f"old.{name}")).cast(kind).alias(name)

    defined = F.col("new").isNotNull()
    return both.select(
        "table_name",
        *[F.when(defined, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in _COMPARED],
        F.col("old.last_created").alias("last_created"),
        F.when(status == "new", 0.0).otherwise(F.col("old.mean")).alias("mean"),
        F.when(status == "new", 0).otherwise(F.col("old.times_run")).alias("times_run"),
        F.when(forced, 1).otherwise(flag("force", "int")).cast("int").alias("force"),
        flag("started", "bigint"),
        F.when(dropped, F.lit(now))
        .when(status == "gone", F.col("old.deleted"))
        .cast("bigint")
        .alias("deleted"),
        flag("waiting", "bigint"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Names per status in lines, see ``name_lines``."""
    return name_lines(diff, "status", "table_name")


def change_notice(diff: DataFrame) -> DataFrame:
    """Lines of a notice on new and updated tables: ``(status, line, notice)``."""
    heading = F.when(F.col("status") == "new", "New tables: ").otherwise("Updated tables: ")
    return diff_summary(diff.where(F.col("status").isin("new", "updated"))).select(
        "status", "line", F.concat(heading, F.col("names"), F.lit(".")).alias("notice")
    )


def _touched(catalog: DataFrame, names: DataFrame) -> DataFrame:
    marked = names.select("table_name", F.lit(True).alias("_hit")).distinct()
    return catalog.join(marked, "table_name", "left")


def set_flag(catalog: DataFrame, column: str, value: int | None, names: DataFrame | None = None) -> DataFrame:
    """Set ``force``, ``started`` or ``waiting`` on the named tables, or on all.

    Names that are not in the catalog change nothing.
    """
    kind = catalog.schema[column].dataType
    if names is None:
        return catalog.withColumn(column, F.lit(value).cast(kind))
    changed = F.when(F.col("_hit"), F.lit(value).cast(kind)).otherwise(F.col(column))
    return _touched(catalog, names).withColumn(column, changed).select(*catalog.columns)


def mark_waiting(catalog: DataFrame, names: DataFrame, now: int) -> DataFrame:
    return set_flag(catalog, "waiting", now, names)


def clear_waiting(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """A cleared waiting flag reads 0."""
    return set_flag(catalog, "waiting", 0, names)


def record_builds(catalog: DataFrame, finished: DataFrame) -> DataFrame:
    """Fold finished runs ``(table_name, start, duration)`` into mean, count and last build.

    The new mean is the old one weighted by its run count, plus the new runs; a
    missing mean or count starts afresh.  The flags of built tables are cleared.
    """
    batch = finished.groupBy("table_name").agg(
        F.sum("duration").alias("_total"),
        F.count("duration").alias("_timed"),
        F.count(F.lit(1)).alias("_runs"),
        F.max_by(F.col("start"), F.struct("start")).alias("_start"),
    )
    hit = F.col("_runs").isNotNull()
    counted = F.col("times_run").isNotNull() & F.col("mean").isNotNull()
    weight = F.when(counted, F.col("times_run")).otherwise(F.lit(0))
    carried = F.when(counted, F.col("mean") * F.col("times_run")).otherwise(F.lit(0.0))
    mean = (carried + F.col("_total")) / F.nullif(weight + F.col("_timed"), F.lit(0))
    times_run = (F.coalesce("times_run", F.lit(0)) + F.col("_runs")).cast("int")

    def keep_unless_hit(name: str) -> Column:
        return F.when(~hit, F.col(name)).alias(name)

    return catalog.join(batch, "table_name", "left").select(
        "table_name",
        *_COMPARED,
        F.coalesce("_start", "last_created").alias("last_created"),
        F.when(hit, mean).otherwise(F.col("mean")).alias("mean"),
        F.when(hit, times_run).otherwise(F.col("times_run")).alias("times_run"),
        keep_unless_hit("force"),
        keep_unless_hit("started"),
        "deleted",
        keep_unless_hit("waiting"),
    )


def catalog_listing(catalog: DataFrame, now: int, keep_days: int = 7) -> DataFrame:
    """Live tables and those deleted fewer than ``keep_days`` whole days ago, newest build first."""
    recent = whole_units(F.lit(now) - F.col("deleted"), DAY) < keep_days
    return (
        catalog.where(~is_deleted() | recent)
        .select("table_name", "interval", "last_created", "mean", "started", "deleted", "force")
        .orderBy(F.col("last_created").desc_nulls_last(), "table_name")
    )
