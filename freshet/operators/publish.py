"""Build a candidate table, then swap it in for the live one.

A table lives under up to four names: the live one, and the live name with one
of the endings below.  Readers see the old table until the swap.  The swap is two renames, with
no live table in between; ``versions`` publishes by a single change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.operators.layout import Layout, Observe, unobserved, laid_out

CANDIDATE = "__candidate"
PREVIOUS = "__previous"
HISTORY = "_history"

GRANTS_PROPERTY = "freshet.grant_select"


def candidate_name(name: str) -> str:
    return name + CANDIDATE


def select_rows(spark: SparkSession, query: str) -> DataFrame:
    """The rows of a definition's query; it may end in semicolons."""
    return spark.sql(query.rstrip(";\n \t"))


def build_candidate(
    df: DataFrame,
    name: str,
    layout: Layout = Layout(),
    grantees: str | None = None,
    observe: Observe = unobserved,
) -> str:
    """Write ``df`` as the candidate of ``name``; an older candidate is dropped."""
    spark = df.sparkSession
    drop_candidate(spark, name)
    laid_out(df, layout, observe).mode("overwrite").format("parquet").saveAsTable(candidate_name(name))
    set_grants(spark, candidate_name(name), grantees)
    return candidate_name(name)


def set_grants(spark: SparkSession, table: str, grantees: str | None) -> None:
    """Who may read is kept with the table; parquet tables have no GRANT."""
    if grantees:
        escaped = grantees.replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{GRANTS_PROPERTY}'='{escaped}')")


def drop_candidate(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {candidate_name(name)}")


def drop_previous(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}{PREVIOUS}")


def drop_plain_view(spark: SparkSession, name: str) -> bool:
    """Drop a plain view that holds the name; a table of that name stays."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return False
    spark.sql(f"DROP VIEW {name}")
    return True


def recover(spark: SparkSession, name: str) -> bool:
    """Undo a swap that stopped half-way: bring the previous table back if there is no live one."""
    if spark.catalog.tableExists(name) or not spark.catalog.tableExists(name + PREVIOUS):
        return False
    spark.sql(f"ALTER TABLE {name}{PREVIOUS} RENAME TO {name}")
    return True


def publish(spark: SparkSession, name: str) -> None:
    """Swap: the live table becomes the previous one, the candidate becomes live."""
    recover(spark, name)
    drop_plain_view(spark, name)
    drop_previous(spark, name)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{PREVIOUS}")
    spark.sql(f"ALTER TABLE {candidate_name(name)} RENAME TO {name}")
    spark.catalog.refreshTable(name)


def replace_table(df: DataFrame, name: str, layout: Layout = Layout()) -> None:
    """Rewrite a table that ``df`` may itself read: candidate, swap, drop the old one."""
    spark = df.sparkSession
    build_candidate(df, name, layout)
    publish(spark, name)
    drop_previous(spark, name)
