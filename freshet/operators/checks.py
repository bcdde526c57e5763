"""Checks of a definition folder before it is taken into the catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.publish import select_rows
from freshet.operators.skew import name_lines

TEST_WITHOUT_QUERY = "test without query"
PROCESSOR_WITHOUT_SELECT = "processor without select"
PROCESSOR_WITHOUT_DDL = "processor without ddl"


def missing_files(classified: DataFrame) -> DataFrame:
    """``(check_name, table_name)`` for each file that another file calls for.

    An empty file counts as missing.  ``classified`` comes from
    ``sources.definitions.classify``.
    """
    # One row per table says which kinds it has: one shuffle serves all three checks.
    full = F.length("text") > 0
    per_table = classified.groupBy("table_name").agg(
        F.bool_or(F.col("kind") == "test").alias("test"),
        F.bool_or(F.col("kind") == "processor").alias("processor"),
        F.bool_or((F.col("kind") == "query") & full).alias("query"),
        F.bool_or((F.col("kind") == "ddl") & full).alias("ddl"),
        F.bool_or((F.col("kind") == "select") & full).alias("chosen"),
    )
    failed = F.array_compact(
        F.array(
            F.when(F.col("test") & ~(F.col("query") | F.col("ddl")), TEST_WITHOUT_QUERY),
            F.when(F.col("processor") & ~F.col("chosen"), PROCESSOR_WITHOUT_SELECT),
            F.when(F.col("processor") & ~F.col("ddl"), PROCESSOR_WITHOUT_DDL),
        )
    )
    return per_table.where("table_name IS NOT NULL").select(
        F.explode(failed).alias("check_name"), "table_name"
    )


def missing_files_report(classified: DataFrame) -> DataFrame:
    """The missing files as lines of names per check."""
    return name_lines(missing_files(classified), "check_name", "table_name")


def declared_keys(definitions: DataFrame, config: Column) -> DataFrame:
    """One row per layout key a definition's settings declare: adds ``setting`` and ``key``."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("setting"), config[s].alias("key")) for s in ("distkey", "sortkey")]
    )
    return (
        definitions.select("*", F.explode(pairs).alias("_pair"))
        .select("*", "_pair.*")
        .drop("_pair")
        .where("key IS NOT NULL AND key <> ''")
    )


def unknown_layout_keys(
    definitions: DataFrame, config: Column, text: str = "query", declared: Column | None = None
) -> DataFrame:
    """Declared layout keys that do not occur in the text of the definition.

    A query with ``*`` may yield any column, so it passes.  Where ``declared`` holds a
    processor's schema, that counts instead, and there ``*`` is no excuse.
    """
    schema = F.lit(None).cast("string") if declared is None else declared
    by_query = ~F.contains(F.col(text), F.col("key")) & ~F.contains(F.col(text), F.lit("*"))
    absent = F.when(schema.isNotNull(), ~F.contains(schema, F.col("key"))).otherwise(by_query)
    return (
        declared_keys(definitions, config).where(absent).select("table_name", "setting", "key")
    )


def analysed_columns(spark: SparkSession, definitions: DataFrame) -> DataFrame:
    """``(table_name, key)``: the columns of each definition's query, as Spark resolves them.

    One analysis per definition and no job.  Queries that cannot be resolved yet,
    because their inputs do not exist, have no rows: leave those to the text check.
    """
    rows = []
    for row in definitions.select("table_name", "query").toLocalIterator():
        try:
            rows += [(row.table_name, column) for column in select_rows(spark, row.query).columns]
        except AnalysisException:
            continue
    return spark.createDataFrame(rows, "table_name string, key string")


def unknown_layout_columns(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared keys ``(table_name, setting, key)`` missing from ``columns(table_name, key)``.

    Only pass keys of tables whose columns are known.
    """
    return keys.join(columns, ["table_name", "key"], "left_anti")
