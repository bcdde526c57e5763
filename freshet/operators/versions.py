"""Publish a table by one change in the catalog.

The live name is a view on one version of the table, ``name__v000007``.  A build writes the
next version under a name nobody reads; a publish alters the view, which is a single change, so
there is a live table at every moment.  Old versions stay for readers that have begun, until
as many newer ones have been published as are to be kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from freshet.operators.layout import Layout, Observe, laid_out, unobserved
from freshet.operators.publish import set_grants

_ENDING = "__v"
# The version that an ordinary table becomes when its name turns into a pointer.
ADOPTED = 0


def version_name(name: str, number: int) -> str:
    return f"{name}{_ENDING}{number:06d}"


def _number(text: str, name: str) -> int | None:
    found = re.search(rf"{re.escape(name.split('.')[-1] + _ENDING)}(\d+)\W*\Z", text)
    return int(found.group(1)) if found else None


def versions(spark: SparkSession, name: str) -> list[int]:
    """The numbers of all stored versions, published or not."""
    schema, table = name.split(".")
    listed = spark.sql(f"SHOW TABLES IN `{schema}` LIKE '{table}{_ENDING}*'").where("NOT isTemporary").toLocalIterator()
    return sorted(n for n in (_number(row.tableName, name) for row in listed) if n is not None)


def live_version(spark: SparkSession, name: str) -> int | None:
    """The version that readers get now; None if there is none or the name is no pointer."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'View Text'").first()
    return _number(described.data_type, name) if described else None


def _drop(spark: SparkSession, name: str, numbers: list[int]) -> None:
    for number in numbers:
        spark.sql(f"DROP TABLE IF EXISTS {version_name(name, number)}")


def build_version(
    df: DataFrame,
    name: str,
    layout: Layout = Layout(),
    grantees: str | None = None,
    observe: Observe = unobserved,
) -> int:
    """Write ``df`` as the next version, unseen by readers; versions of builds that stopped are dropped.

    One build of a table runs at a time.
    """
    spark, live = df.sparkSession, live_version(df.sparkSession, name)
    stored = versions(spark, name)
    unseen = [n for n in stored if n > (ADOPTED if live is None else live)]
    _drop(spark, name, unseen)
    number = max([ADOPTED, *stored]) + 1
    laid_out(df, layout, observe).format("parquet").saveAsTable(version_name(name, number))
    set_grants(spark, version_name(name, number), grantees)
    return number


def point(spark: SparkSession, name: str, number: int) -> None:
    """Let the live name stand for a version: new readers get it from here on.

    A view, whatever it shows, is altered in place.  Only an ordinary table has to be renamed
    first, once in its life; ``recover`` undoes that if the work stops in between.
    """
    shown = f"SELECT * FROM {version_name(name, number)}"
    if spark.catalog.tableExists(name):
        if spark.catalog.getTable(name).tableType == "VIEW":
            spark.sql(f"ALTER VIEW {name} AS {shown}")
            return
        spark.sql(f"ALTER TABLE {name} RENAME TO {version_name(name, ADOPTED)}")
    spark.sql(f"CREATE VIEW {name} AS {shown}")


def recover(spark: SparkSession, name: str) -> bool:
    """Point at the table that was renamed to become the first version, if there is no live one."""
    if spark.catalog.tableExists(name) or ADOPTED not in versions(spark, name):
        return False
    spark.sql(f"CREATE VIEW {name} AS SELECT * FROM {version_name(name, ADOPTED)}")
    return True


def retire(spark: SparkSession, name: str, keep: int = 1) -> list[int]:
    """Drop published versions beyond the live one and the ``keep`` before it."""
    live = live_version(spark, name)
    old = [n for n in versions(spark, name) if live is not None and n < live]
    gone = old[: max(0, len(old) - keep)]
    _drop(spark, name, gone)
    return gone


def roll_back(spark: SparkSession, name: str) -> int | None:
    """Point at the newest version before the live one; None if there is none."""
    live = live_version(spark, name)
    older = [n for n in versions(spark, name) if live is not None and n < live]
    if not older:
        return None
    point(spark, name, older[-1])
    return older[-1]


def publish_steps(df: DataFrame, name: str, layout: Layout = Layout(), keep: int = 1) -> Iterator[str]:
    """Build, point, retire; yields the name of each step once it is done.

    Whoever stops taking steps leaves a live table behind, and the next publish cleans up.
    """
    spark = df.sparkSession
    recover(spark, name)
    number = build_version(df, name, layout)
    yield "built"
    point(spark, name, number)
    yield "pointed"
    retire(spark, name, keep)
    yield "retired"


def replace_table(df: DataFrame, name: str, layout: Layout = Layout(), keep: int = 1) -> None:
    """All steps at once; ``df`` may read the table itself."""
    for _ in publish_steps(df, name, layout, keep):
        pass
