"""Joins and listings that stay even when one key holds much of the data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions.times import whole_units
from freshet.session import stage, stage_sized

# About as many rows of one key as a task should join.
ROWS_PER_TASK = 50_000


class HotKeys(NamedTuple):
    """Key values with more rows than a task should join: a stored ``(key, _salts)``, and their number."""

    keys: DataFrame
    n: int


def find_hot_keys(rows: DataFrame, key: str, rows_per_task: int | None = None) -> HotKeys:
    """How many parts each key's rows need; keys that need one are left out.

    Counts collapse before the shuffle.  At most one key in ``rows_per_task`` rows is hot.
    """
    parts = F.ceil(F.count(F.lit(1)) / (rows_per_task or ROWS_PER_TASK)).cast("int")
    return HotKeys(*stage_sized(rows.groupBy(key).agg(parts.alias("_salts")).where("_salts > 1")))


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str, by: list[str], hot: HotKeys) -> DataFrame:
    """Join a left side whose keys may be hot with a right side of one row per key.

    Left rows of a hot key are parted by a hash of ``by`` into as many groups as the key
    needs; its right row is repeated once per group.  Every row keeps its partners.
    """
    if not hot.n:
        return left.join(right, on, how)
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*by), salts).cast("int")
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    parted = left.join(hot.keys, on, "left").withColumn("_salt", salt).drop("_salts")
    repeated = right.join(hot.keys, on, "left").withColumn("_salt", copies).drop("_salts")
    return parted.join(repeated, [on, "_salt"], how).drop("_salt")


def name_lines(rows: DataFrame, group: str, name: str, per_line: int = 1000) -> DataFrame:
    """Names of each group as comma-separated lines: ``(group, line, names, n)``.

    The lines of a group, one after another, are its names in order, ``per_line`` to a
    line; this holds for every size.  ``group`` is not null.  Places come from a range
    sort: each task numbers its rows and adds what earlier tasks hold of the group, so
    no task takes in a whole group.
    """
    in_order = rows.select(group, name).orderBy(group, name)
    ordered, _ = stage(in_order.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits are the task.
    ordered = ordered.withColumn("_task", F.shiftright("_at", 33))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        ordered.groupBy(group, "_task")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return (
        ordered.join(shares, [group, "_task"])
        .groupBy(group, whole_units(place, per_line).alias("line"))
        .agg(
            F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"),
            F.count(F.lit(1)).alias("n"),
        )
    )
