"""What is due, why, and in which order to rebuild it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.times import MINUTE, whole_units
from freshet.operators.catalog import is_deleted, set_flag
from freshet.operators.graph import COMPACT_EVERY, levels, union_all
from freshet.session import sized
from freshet.session import stage_sized as stage

# Seconds after which a waiting flag no longer counts, and the
# multiple of the mean duration after which a run is overdue.
WAITING_EXPIRES = 7200
OVERDUE_FACTOR = 5


def is_waiting() -> Column:
    return F.coalesce(F.col("waiting"), F.lit(0)) != 0


def waits_too_long(now: int, threshold: int = WAITING_EXPIRES) -> Column:
    return is_waiting() & (F.lit(now) - F.col("waiting") > threshold)


def waiting_status(catalog: DataFrame, now: int, threshold: int = WAITING_EXPIRES) -> DataFrame:
    return catalog.select(
        "table_name",
        is_waiting().alias("waiting"),
        waits_too_long(now, threshold).alias("too_long"),
    )


def is_running() -> Column:
    return F.coalesce(F.col("started"), F.lit(0)) != 0


def is_overdue(now: int) -> Column:
    """Running for more than five times its mean; without a mean nothing is known."""
    known = F.coalesce(F.col("mean"), F.lit(0.0)) > 0
    return is_running() & known & (F.lit(now) - F.col("started") > OVERDUE_FACTOR * F.col("mean"))


def overdue_runs(catalog: DataFrame, now: int) -> DataFrame:
    """Running tables that are overdue, with their running time and the bound it passed."""
    return catalog.where(is_overdue(now)).select(
        "table_name",
        "started",
        (F.lit(now) - F.col("started")).cast("bigint").alias("running_seconds"),
        (OVERDUE_FACTOR * F.col("mean")).alias("bound_seconds"),
    )


def _in_queue(now: int) -> Column:
    age = whole_units(F.lit(now) - F.col("last_created"), MINUTE)
    stale = age - F.col("interval") > 0
    due = F.coalesce(F.col("force") == 1, F.lit(False)) | F.col("last_created").isNull()
    return (due | F.coalesce(stale, F.lit(False))) & ~is_deleted()


def refresh_queue(catalog: DataFrame, now: int) -> DataFrame:
    """Names due for a rebuild, forced ones first.

    A table is due if forced, never built, or older than its interval in whole
    minutes; without an interval age does not count.
    """
    return (
        catalog.where(_in_queue(now))
        .select("table_name", "force")
        .orderBy(F.col("force").desc_nulls_last(), "table_name")
    )


def _decision(now: int, interval: Column) -> Column:
    """``struct(build, reason)`` for a table, given the interval that applies to it."""
    known_mean = F.coalesce(F.col("mean"), F.lit(0.0)) > 0
    age_minutes = (F.lit(now) - F.col("last_created")) / float(MINUTE)

    def outcome(build: bool, reason: str) -> Column:
        return F.struct(F.lit(build).alias("build"), F.lit(reason).alias("reason"))

    return (
        F.when(is_waiting() & ~waits_too_long(now), outcome(False, "waiting"))
        .when(is_running() & known_mean & ~is_overdue(now), outcome(False, "running"))
        .when(F.coalesce(F.col("force"), F.lit(0)) != 0, outcome(True, "forced"))
        .when(F.col("last_created").isNull(), outcome(True, "never built"))
        .when(interval.isNull(), outcome(True, "no interval"))
        .when(age_minutes <= interval, outcome(False, "fresh"))
        .otherwise(outcome(True, "stale"))
    )


def refresh_decision(catalog: DataFrame, now: int) -> DataFrame:
    """``(table_name, build, reason)`` for every table by its own interval."""
    return catalog.select("table_name", _decision(now, F.col("interval")).alias("d")).select(
        "table_name", "d.build", "d.reason"
    )


_STATE = ["table_name", "interval", "last_created", "mean", "force", "started", "waiting"]

# Stands for "no interval anywhere above": weaker than every real one, builds always.
_NO_INTERVAL = -1


def planned_tables(catalog: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """``(table_name, interval)`` of all tables to rebuild now.

    The queue's tables are taken first.  A table that is built asks for what it
    reads; those without an interval of their own go by the asking table's, and
    a table that need not be built asks for nothing.  If several tables ask, the
    shortest interval decides: if it does not call for a build, no other does.
    ``edges`` is read in every round, so pass a stored table.
    """
    state, _ = stage(catalog.where(~is_deleted()).select(*_STATE))
    own = F.when(F.col("interval") != 0, F.col("interval"))
    applies = F.coalesce(own, F.col("asked"))
    real = F.when(applies != _NO_INTERVAL, applies)

    def to_build(asked: DataFrame) -> DataFrame:
        return (
            state.join(asked, "table_name")
            .where(_decision(now, real)["build"])
            .select("table_name", applies.cast("int").alias("interval"))
        )

    def ask(frontier: DataFrame) -> DataFrame:
        return (
            edges.join(frontier.withColumnRenamed("table_name", "src"), "src")
            .groupBy(F.col("dst").alias("table_name"))
            .agg(F.min("interval").alias("asked"))
        )

    first = catalog.where(_in_queue(now)).select("table_name", F.lit(_NO_INTERVAL).alias("asked"))
    frontier, n = stage(to_build(first))
    rounds, n_known = [frontier], n
    while n:
        known = sized(_best(rounds), n_known).withColumnRenamed("interval", "known")
        # Only what is new, or goes by a shorter interval than before, asks on.
        step = (
            to_build(ask(frontier))
            .join(known, "table_name", "left")
            .where(F.col("known").isNull() | (F.col("interval") < F.col("known")))
            .select("table_name", "interval")
        )
        frontier, n = stage(step)
        rounds.append(frontier)
        n_known += n
        if len(rounds) == COMPACT_EVERY:
            rounds = [stage(_best(rounds))[0]]
    return _best(rounds).withColumn(
        "interval", F.when(F.col("interval") != _NO_INTERVAL, F.col("interval"))
    )


def _best(rounds: list[DataFrame]) -> DataFrame:
    return union_all(rounds).groupBy("table_name").agg(F.min("interval").alias("interval"))


def build_levels(names: DataFrame, edges: DataFrame) -> DataFrame:
    """``(table_name, level)``: a table's level is above the levels of all it reads."""
    nodes = names.select(F.col("table_name").alias("node"))
    return levels(nodes, edges).withColumnRenamed("node", "table_name")


def refresh_plan(catalog: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """``(table_name, interval, level)``: what to rebuild now, lower levels first."""
    edges, _ = stage(edges.select("src", "dst").distinct())
    planned, _ = stage(planned_tables(catalog, edges, now))
    return planned.join(build_levels(planned, edges), "table_name")


def force_propagation(catalog: DataFrame, reached: DataFrame) -> DataFrame:
    """Force the tables in ``reached(node)``; names not in the catalog change nothing."""
    return set_flag(catalog, "force", 1, reached.withColumnRenamed("node", "table_name"))
