"""Take a folder of definitions into the catalog, as a whole or by what has changed in it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.text import mentioned_names
from freshet.operators import catalog as catalogs
from freshet.operators import checks, graph
from freshet.operators.lineage import dependency_edges
from freshet.operators.settings import table_configs
from freshet.operators.skew import find_hot_keys, spread_join
from freshet.session import stage_sized as stage
from freshet.sources.definitions import (
    classify,
    decode_config,
    encode_config,
    load_ddl,
    load_definitions,
    load_settings,
    scan_folder,
    tables_of_files,
)
from freshet.sources.manifest import Changes, take_changes


class PlanError(Exception):
    """The folder cannot be taken in; the message gives examples, ``problems`` has all rows."""

    def __init__(self, reason: str, problems: DataFrame):
        sample = [", ".join(str(v) for v in row) for row in problems.take(20)]
        super().__init__(f"{reason}: {'; '.join(sample)}")
        self.problems = problems


class Plan(NamedTuple):
    catalog: DataFrame
    edges: DataFrame
    diff: DataFrame


def _refuse(reason: str, problems: DataFrame) -> None:
    problems, n = stage(problems)
    if n:
        raise PlanError(reason, problems)


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], catalogs.CATALOG_SCHEMA)


def replan(
    spark: SparkSession, folder: str, catalog: DataFrame, now: int, strict: bool = False
) -> Plan:
    """Scan, check, link, settle and compare a folder with the catalog.

    Refuses missing files, sources without an interval and unknown layout keys;
    cycles only if ``strict``.  Nothing is written: store ``catalog`` with
    ``publish.replace_table``.
    """
    files, _ = stage(classify(scan_folder(spark, folder)))
    _refuse("missing files", checks.missing_files(files))

    definitions, _ = stage(load_definitions(files))
    edges, _ = stage(dependency_edges(definitions))
    if strict:
        _refuse("cycles", graph.cyclic_core(edges))
    nodes = definitions.select(F.col("table_name").alias("node"), "interval")
    _refuse(
        "sources without an interval",
        graph.sources_without(nodes, edges, "interval").select("node"),
    )

    configured, _ = stage(table_configs(definitions, load_settings(files)))
    declared = load_ddl(files).withColumnRenamed("text", "ddl")
    checked = configured.join(declared, "table_name", "left")
    _refuse(
        "unknown layout keys",
        checks.unknown_layout_keys(checked, F.col("config"), declared=F.col("ddl")),
    )

    encoded = configured.withColumn("config", encode_config(F.col("config")))
    diff = catalogs.definition_diff(catalog, encoded)
    return Plan(catalogs.apply_definitions(catalog, encoded, now), edges, diff)


class FolderState(NamedTuple):
    """What is known of a folder, as stored tables.

    ``classified`` files, ``definitions(table_name, query, interval)``, ``mentions(src, dst)`` of
    any names, ``edges(src, dst)`` between definitions, ``levels(node, level)``,
    ``configs(table_name, config)`` with the config as text, and whether there are cycles.
    """

    files: DataFrame
    classified: DataFrame
    definitions: DataFrame
    mentions: DataFrame
    edges: DataFrame
    levels: DataFrame
    configs: DataFrame
    cyclic: bool


def _mentions(definitions: DataFrame) -> DataFrame:
    return definitions.select(
        F.col("table_name").alias("src"), F.explode(mentioned_names(F.col("query"))).alias("dst")
    )


def _configs(definitions: DataFrame, settings: DataFrame) -> DataFrame:
    made = table_configs(definitions.select("table_name"), settings)
    return made.select("table_name", encode_config(F.col("config")).alias("config"))


def _between(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """The mentions of ``names(table_name)``."""
    mentions, _ = stage(mentions)
    known = names.select(F.col("table_name").alias("dst"))
    return spread_join(mentions, known, "dst", "left_semi", ["src"], find_hot_keys(mentions, "dst")).select("src", "dst")


def folder_state(files: DataFrame) -> FolderState:
    """All of it, from all files ``(path, text)``."""
    files, _ = stage(files)
    classified, _ = stage(classify(files))
    definitions, _ = stage(load_definitions(classified))
    mentions, _ = stage(_mentions(definitions))
    edges, _ = stage(_between(mentions, definitions))
    nodes = definitions.select(F.col("table_name").alias("node"))
    levels, _ = stage(graph.levels(nodes, edges))
    configs, _ = stage(_configs(definitions, load_settings(classified)))
    return FolderState(files, classified, definitions, mentions, edges, levels, configs, not graph.is_acyclic(edges))


def _without(rows: DataFrame, names: DataFrame, column: str = "table_name") -> DataFrame:
    return rows.join(names.select(F.col("table_name").alias(column)), column, "left_anti")


def update_state(state: FolderState, changes: Changes) -> FolderState:
    """The state after ``changes``, equal to a new one; computed for what the changes reach.

    Files of touched tables are classified again, touched definitions are read again, edges are
    renewed where a query changed or a name came or went, levels only for tables above a changed
    edge, settings for tables in the scope of a changed one.  With cycles in the graph, levels
    are computed as a whole.
    """
    files, _ = stage(take_changes(state.files, changes))
    touched, _ = stage(changes.files.select("path").unionByName(changes.gone))

    # Files: those of a touched file's table are classified together.
    belonging, _ = stage(tables_of_files(state.files.unionByName(changes.files.select("path", "text"))).distinct())
    tables = belonging.join(touched, "path", "left_semi").select("belongs_to").distinct()
    again, _ = stage(belonging.where("belongs_to IS NOT NULL").join(tables, "belongs_to", "left_semi").select("path").unionByName(touched).distinct())
    before = state.classified.join(again, "path", "left_semi")
    after, _ = stage(classify(files.join(again, "path", "left_semi")))
    classified, _ = stage(state.classified.join(again, "path", "left_anti").unionByName(after))

    # Definitions.
    names, _ = stage(before.unionByName(after).where("table_name IS NOT NULL").select("table_name").distinct())
    renewed, _ = stage(load_definitions(classified.join(names, "table_name", "left_semi")))
    kept = _without(state.definitions, names)
    definitions, _ = stage(kept.unionByName(renewed))
    added, _ = stage(_without(renewed.select("table_name"), state.definitions))
    removed, _ = stage(_without(state.definitions.join(names, "table_name", "left_semi").select("table_name"), renewed))

    # Edges: from renewed definitions, and to names that came.
    mentions, _ = stage(_without(state.mentions, names, "src").unionByName(_mentions(renewed)))
    lasting = _without(_without(state.edges, names, "src"), removed, "dst")
    to_added = _without(_between(mentions, added), names, "src")
    edges, _ = stage(graph.union_all([lasting, to_added, _between(_mentions(renewed), definitions)]))

    levels, cyclic = _update_levels(state, definitions, edges, added, removed)

    # Settings.
    old, new = load_settings(state.classified), load_settings(classified)
    scopes, n_scopes = stage(old.exceptAll(new).unionByName(new.exceptAll(old)).select("scope").distinct())
    unsettled = added.select("table_name")
    if n_scopes:
        schema = F.split_part("table_name", F.lit("."), F.lit(1))
        of = definitions.select("table_name", F.explode(F.array(F.lit(""), schema, F.col("table_name"))).alias("scope"))
        reached = spread_join(of, scopes, "scope", "left_semi", ["table_name"], find_hot_keys(of, "scope"))
        unsettled = unsettled.unionByName(reached.select("table_name")).distinct()
    unsettled, _ = stage(unsettled)
    settled = _without(_without(state.configs, unsettled), removed)
    configs, _ = stage(settled.unionByName(_configs(unsettled, new)))
    return FolderState(files, classified, definitions, mentions, edges, levels, configs, cyclic)


def _update_levels(
    state: FolderState, definitions: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame
) -> tuple[DataFrame, bool]:
    """Levels after a change of edges, and whether there are cycles.

    Only tables that read, directly or through others, one whose own edges differ can have another level.
    """
    differing = edges.exceptAll(state.edges).unionByName(state.edges.exceptAll(edges))
    starts = differing.select(F.col("src").alias("node")).unionByName(added.select(F.col("table_name").alias("node")))
    upwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = definitions.select(F.col("table_name").alias("node"))
    above, n = stage(graph.reachable(upwards, starts.distinct()).join(known, "node", "left_semi"))
    rest, _ = stage(_without(state.levels.withColumnRenamed("node", "table_name"), removed).withColumnRenamed("table_name", "node").join(above, "node", "left_anti"))
    if not n:
        return rest, state.cyclic
    links = edges.where("src <> dst").join(above.withColumnRenamed("node", "src"), "src", "left_semi")
    links, _ = stage(links)
    inner, _ = stage(links.join(above.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    cyclic = not graph.is_acyclic(inner) or not graph.is_acyclic(edges.where("src = dst"))
    if cyclic or state.cyclic:
        whole, _ = stage(graph.levels(known, edges))
        return whole, cyclic or not graph.is_acyclic(edges)
    # What unchanged tables below give; then longest walks among the changed ones, round by round.
    given = links.join(rest.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("given"))
    best, _ = stage(above.join(given, "node", "left").select("node", F.coalesce("given", F.lit(0)).alias("level")))
    front, n = best, 1
    while n:
        step = inner.join(front.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("higher"))
        raised = best.join(step, "node", "left")
        front, n = stage(raised.where(F.col("higher") > F.col("level")).select("node", F.col("higher").alias("level")))
        if n:
            best, _ = stage(raised.select("node", F.greatest("level", F.coalesce("higher", "level")).alias("level")))
    return rest.unionByName(best), False


def replan_changes(
    state: FolderState, changes: Changes, catalog: DataFrame, now: int, strict: bool = False
) -> tuple[FolderState, Plan]:
    """``replan`` from the state before and what has changed since; refuses for the same reasons."""
    new = update_state(state, changes)
    _refuse("missing files", checks.missing_files(new.classified))
    if strict and new.cyclic:
        _refuse("cycles", graph.cyclic_core(new.edges))
    nodes = new.definitions.select(F.col("table_name").alias("node"), "interval")
    _refuse("sources without an interval", graph.sources_without(nodes, new.edges, "interval").select("node"))
    encoded = new.definitions.join(new.configs, "table_name")
    declared = load_ddl(new.classified).withColumnRenamed("text", "ddl")
    checked = encoded.join(declared, "table_name", "left")
    _refuse("unknown layout keys", checks.unknown_layout_keys(checked, decode_config(F.col("config")), declared=F.col("ddl")))
    diff = catalogs.definition_diff(catalog, encoded)
    return new, Plan(catalogs.apply_definitions(catalog, encoded, now), new.edges, diff)
