"""Which definition reads which."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from freshet.functions.text import mentioned_names, retarget
from freshet.operators import graph
from freshet.operators.skew import find_hot_keys, spread_join
from freshet.session import scratch_schema
from freshet.session import stage_sized as stage


class DependentsBroken(Exception):
    """Views that would no longer resolve over the table to be published."""

    def __init__(self, table: str, broken: dict[str, str]):
        super().__init__(f"publishing {table} would break {', '.join(broken)}")
        self.table, self.broken = table, broken


def quoted(name: str) -> str:
    """A dotted name with each part in back quotes."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def dependency_edges(definitions: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """``(src, dst)``: the query of ``src`` names the definition ``dst``.

    The text is cut into dotted pairs once and joined on the name, so the cost is
    linear in the text.  A name that a large share of all definitions reads is a
    hot join key, parted by ``rows_per_task``.  ``definitions`` has one row per table.
    """
    mentioned, _ = stage(
        definitions.select(
            F.col("table_name").alias("src"), F.explode(mentioned_names(F.col("query"))).alias("dst")
        )
    )
    names = definitions.select(F.col("table_name").alias("dst"))
    hot = find_hot_keys(mentioned, "dst", rows_per_task)
    return spread_join(mentioned, names, "dst", "left_semi", ["src"], hot).select("src", "dst")


def readers_of(definitions: DataFrame, name: str) -> DataFrame:
    """The definitions whose query reads one table, without the table itself."""
    return definitions.where(
        F.array_contains(mentioned_names(F.col("query")), name) & (F.col("table_name") != name)
    )


def catalog_views(spark: SparkSession, schemas: list[str] | None = None) -> DataFrame:
    """``(table_name, query)`` of the plain views of some or all schemas, from the catalog alone."""
    if schemas is None:
        schemas = [row.namespace for row in spark.sql("SHOW SCHEMAS").toLocalIterator()]
    rows = []
    for schema in schemas:
        for view in spark.sql(f"SHOW VIEWS IN {quoted(schema)}").where("NOT isTemporary").toLocalIterator():
            name = f"{view.namespace}.{view.viewName}"
            rows.append((name, spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)} AS JSON").first()[0]))
    described = spark.createDataFrame(rows, "table_name string, described string")
    return described.select(
        "table_name", F.get_json_object("described", "$.view_text").alias("query")
    )


def dependent_views(spark: SparkSession, name: str, schemas: list[str] | None = None) -> DataFrame:
    """``(table_name, query, level)``: plain views that read the table, or views that do.

    A view's level is above those of the views it reads.
    """
    views = catalog_views(spark, schemas).where(F.col("table_name") != name)
    known, _ = stage(views.unionByName(spark.createDataFrame([(name, "")], views.schema)))
    edges, _ = stage(dependency_edges(known).where("src <> dst"))
    upwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reading = graph.reachable(upwards, spark.createDataFrame([(name,)], "node string")).where(F.col("node") != name)
    levels = graph.levels(reading, edges).withColumnRenamed("node", "table_name")
    return known.join(levels, "table_name")


def _in_order(spark: SparkSession, name: str, schemas: list[str] | None) -> list[Row]:
    # Views over one table; each is analysed here on the driver anyway.
    return list(dependent_views(spark, name, schemas).orderBy("level", "table_name").toLocalIterator())


def check_dependents(spark: SparkSession, name: str, candidate: str, schemas: list[str] | None = None) -> list[Row]:
    """The views over ``name`` in build order, if all of them resolve over ``candidate`` as well.

    Each is analysed in a schema of its own where its inputs bear their names, so column names
    that carry the table's name still resolve; nothing is run.  ``DependentsBroken`` tells which
    views fail, directly or because a view that they read does.
    """
    ordered = _in_order(spark, name, schemas)
    trials: dict[str, str] = {}
    stand_ins: dict[str, str] = {}
    broken: dict[str, str] = {}

    def stand_in(table: str, text: str) -> None:
        schema, short = table.split(".")
        if schema not in trials:
            trials[schema] = scratch_schema(spark, "trial")
        spark.sql(f"CREATE VIEW {trials[schema]}.{quoted(short)} AS {text}")
        stand_ins[table] = f"{trials[schema]}.{quoted(short)}"

    try:
        if ordered:
            stand_in(name, f"SELECT * FROM {candidate}")
        for view in ordered:
            text = view.query
            for table, other in stand_ins.items():
                text = retarget(text, table, other)
            failed = [table for table in broken if retarget(text, table, "") != text]
            try:
                if failed:
                    broken[view.table_name] = f"reads {failed[0]}"
                else:
                    stand_in(view.table_name, text)
            except AnalysisException as error:
                broken[view.table_name] = error.getMessage() or str(error)
    finally:
        for schema in trials.values():
            spark.sql(f"DROP SCHEMA {schema} CASCADE")
    if broken:
        raise DependentsBroken(name, broken)
    return ordered


def recreate_views(spark: SparkSession, ordered: list[Row]) -> list[str]:
    """Re-create views, given in build order; they follow the columns of what they read from then on."""
    for view in ordered:
        spark.sql(f"CREATE OR REPLACE VIEW {quoted(view.table_name)} WITH SCHEMA EVOLUTION AS {view.query}")
    return [view.table_name for view in ordered]


def refresh_dependent_views(spark: SparkSession, name: str, schemas: list[str] | None = None) -> list[str]:
    """Re-create all views over a table whose columns changed, those over views after these.

    Views are bound by name, so a swap alone needs no change to them.
    """
    return recreate_views(spark, _in_order(spark, name, schemas))
