"""Layered settings and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.skew import find_hot_keys, spread_join

# Texts that reset a setting.
RESET_VALUES = ("null", "None", "")

GRANTS = "grant_select"


def effective_settings(settings: DataFrame) -> DataFrame:
    """The strongest layer's value per ``(table_name, key)``; a reset value gives NULL.

    Input rows are ``(table_name, level, key, value)``.
    """
    value = F.when(~F.col("value").isin(*RESET_VALUES), F.col("value"))
    # A struct is never NULL itself, so a reset in the last layer still wins.
    return (
        settings.groupBy("table_name", "key")
        .agg(F.max_by(F.struct(value.alias("value")), "level").alias("last"))
        .select("table_name", "key", "last.value")
    )


def _merge(names: Column, layer: Column) -> Column:
    value = layer["value"]
    entries = F.split(F.replace(value, F.lit(" "), F.lit("")), ",")

    def marked(sign: str) -> Column:
        picked = F.filter(entries, lambda e: F.startswith(e, F.lit(sign)))
        return F.transform(picked, lambda e: F.substr(e, F.lit(2)))

    changed = F.array_except(F.array_union(names, marked("+")), marked("-"))
    none = F.array().cast("array<string>")
    return (
        F.when(value.isNull() | (value == ""), names)
        .when(value.isin("null", "None"), none)
        .when(F.rlike(value, F.lit("[+-]")), changed)
        .otherwise(F.array_distinct(entries))
    )


def effective_grants(acl: DataFrame) -> DataFrame:
    """``(table_name, grantees)``: the layers ``(table_name, level, value)`` applied in order.

    Bare names replace what came before; ``+name`` adds and ``-name`` removes, and
    in a mixed layer only the marked names count.  A table has one row per level.
    """
    layers = acl.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("level", "value"))).alias("layers")
    )
    folded = F.aggregate("layers", F.array().cast("array<string>"), _merge)
    return layers.select("table_name", F.array_sort(folded).alias("grantees"))


def grant_text(grantees: Column) -> Column:
    return F.array_join(grantees, ", ")


def settings_for_tables(tables: DataFrame, settings: DataFrame) -> DataFrame:
    """Fan ``(scope, level, key, value)`` rows out to ``(table_name, level, key, value)``.

    Each scope's rows (a few files) travel as one array.  The folder-wide and the
    schema scopes are read by many tables, so the join is spread.
    """
    bundles = settings.groupBy("scope").agg(
        F.collect_list(F.struct("level", "key", "value")).alias("bundle")
    )
    schema = F.split_part("table_name", F.lit("."), F.lit(1))
    scopes = tables.select(
        "table_name", F.explode(F.array(F.lit(""), schema, F.col("table_name"))).alias("scope")
    )
    return (
        spread_join(scopes, bundles, "scope", "inner", ["table_name"], find_hot_keys(scopes, "scope"))
        .select("table_name", F.explode("bundle").alias("s"))
        .select("table_name", "s.*")
    )


def table_configs(tables: DataFrame, settings: DataFrame) -> DataFrame:
    """``(table_name, config)``: the effective settings of each table as a map.

    ``settings`` rows carry scopes; tables without any setting get an empty map.
    """
    fanned = settings_for_tables(tables, settings)
    grants = effective_grants(
        fanned.where(F.col("key") == GRANTS).select("table_name", "level", "value")
    ).select("table_name", F.lit(GRANTS).alias("key"), grant_text(F.col("grantees")).alias("value"))
    others = effective_settings(fanned.where(F.col("key") != GRANTS))
    maps = (
        others.unionByName(grants)
        .groupBy("table_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return tables.join(maps, "table_name", "left").withColumn("config", F.coalesce("config", empty))
