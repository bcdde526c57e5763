"""The registered queries: each operator over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from freshet.functions import text as texts
from freshet.functions import times
from freshet.operators import (
    catalog as catalogs,
)
from freshet.operators import (
    checks,
    expectations,
    graph,
    lineage,
    publish,
    runlog,
    settings,
    snapshots,
    versions,
)
from freshet.operators.layout import Layout, read_table
from freshet.operators.throttle import throttle
from freshet.plans import refresh, replan, samples
from freshet.plans.rebuild import View, rebuild, rebuild_set
from freshet.plans.samples import NOW
from freshet.session import scratch_schema, shared_dir, stage
from freshet.sources import definitions as folder
from freshet.sources import manifest
from freshet.sources.delimited import read_delimited, write_delimited
from freshet.streaming.throttle import throttle_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _warehouse(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """A new schema with the named sample tables in it, as external tables."""
    schema = scratch_schema(spark)
    for name in tables:
        spark.sql(f"CREATE TABLE {schema}.{name} USING parquet LOCATION '{sf_dir}/{name}.parquet'")
    return schema


def _clock(now: int = NOW) -> Callable[[], int]:
    return lambda: now


SEGMENT_SALES = """
select c_mktsegment, count(*) as orders,
    cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total
from {0}.orders -- not {0}.customer
join {0}.customer on o_custkey = c_custkey
group by c_mktsegment;
"""

SEGMENT_TESTS = """
select count(*) = count(distinct c_mktsegment) as one_row_per_segment from {0}.segment_sales;
select min(total) > 0 as sales_in_each_segment from {0}.segment_sales;
"""

ORDER_COUNTS = """
select o_custkey, o_orderstatus, count(*) as orders,
    cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total
from {0}.orders group by o_custkey, o_orderstatus
"""


# The life of a table ------------------------------------------------------------


@query
def mv_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build twice, test, swap, read back."""
    schema = _warehouse(spark, sf_dir, "orders", "customer")
    view = View(
        name=f"{schema}.segment_sales",
        query=SEGMENT_SALES.format(schema),
        config={"diststyle": "even", "grant_select": "jane, john"},
        tests=SEGMENT_TESTS.format(schema),
    )
    rebuild(spark, view, _clock())
    rebuild(spark, view, _clock())
    return spark.table(view.name)


@query
def mv_view_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain view gives way to the table of its name."""
    schema = _warehouse(spark, sf_dir, "orders")
    name = f"{schema}.order_counts"
    spark.sql(f"CREATE VIEW {name} AS SELECT o_custkey FROM {schema}.orders")
    rebuild(spark, View(name=name, query=ORDER_COUNTS.format(schema)), _clock())
    is_view = spark.catalog.getTable(name).tableType == "VIEW"
    return spark.table(name).withColumn("is_view", F.lit(is_view))


@query
def mv_dependent_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a table that has gained columns is found in the catalog and follows it."""
    schema = _warehouse(spark, sf_dir, "orders")
    name = f"{schema}.order_counts"
    text = ORDER_COUNTS.format(schema)
    without = publish.select_rows(spark, text).drop("total")
    publish.replace_table(without, name)
    spark.sql(f"CREATE VIEW {schema}.repeated AS SELECT * FROM {name} WHERE orders > 1")
    publish.replace_table(publish.select_rows(spark, text), name)
    lineage.refresh_dependent_views(spark, name)
    return spark.table(f"{schema}.repeated")


@query
def mv_publish_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a new reader, and one that began before the publish, find after each of its steps."""
    schema = _warehouse(spark, sf_dir, "orders")
    name, found = f"{schema}.order_counts", []
    for publish_no, condition in enumerate(("o_orderstatus = 'F'", "true", "orders > 1")):
        begun = spark.table(name) if spark.catalog.tableExists(name) else None
        rows = publish.select_rows(spark, ORDER_COUNTS.format(schema)).where(condition)
        for step in versions.publish_steps(rows, name, Layout(sortkey="o_custkey")):
            live = spark.table(name).count() if spark.catalog.tableExists(name) else None
            found.append((publish_no, step, live, begun.count() if begun else None))
    stored = len(versions.versions(spark, name))
    steps = spark.createDataFrame(found, "publish int, step string, live_rows bigint, begun_rows bigint")
    return steps.withColumn("stored_versions", F.lit(stored))


@query
def mv_dependent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views over views follow a table that gains a column; a build that would break one is refused."""
    schema = _warehouse(spark, sf_dir, "orders")
    name, text = f"{schema}.order_counts", ORDER_COUNTS.format(schema)
    plain = f"select o_custkey, o_orderstatus, orders, total from ({text})"
    rebuild(spark, View(name=name, query=plain, keep_versions=1), _clock())
    spark.sql(f"CREATE VIEW {schema}.repeated AS SELECT * FROM {name} WHERE order_counts.orders > 1")
    spark.sql(
        f"""CREATE VIEW {schema}.spent AS SELECT repeated.*, total / orders > 100000 AS large
        FROM {schema}.repeated"""
    )
    rebuild(spark, View(name=name, query=f"select *, orders % 2 as odd from ({text})", keep_versions=1), _clock())
    try:
        rebuild(spark, View(name=name, query=f"select o_custkey, orders from ({text})", keep_versions=1), _clock())
        refused = ""
    except lineage.DependentsBroken as error:
        refused = ", ".join(view.split(".")[1] for view in error.broken)
    return spark.table(f"{schema}.spent").withColumn("refused", F.lit(refused))


@query
def mv_layout_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed on one key, joined on it without a shuffle."""
    schema = _warehouse(spark, sf_dir, "orders", "customer")
    layout = Layout(distkey="o_custkey", sortkey="o_orderstatus")
    for name, text in (
        ("order_counts", ORDER_COUNTS.format(schema)),
        ("buyers", f"select c_custkey as o_custkey, c_mktsegment from {schema}.customer"),
    ):
        own = layout if name == "order_counts" else Layout(distkey="o_custkey")
        publish.build_candidate(publish.select_rows(spark, text), f"{schema}.{name}", own)
        publish.publish(spark, f"{schema}.{name}")
    return spark.table(f"{schema}.order_counts").join(spark.table(f"{schema}.buyers"), "o_custkey")


@query
def mv_layout_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table sorted for range filters, joined to one kept on every node."""
    schema = _warehouse(spark, sf_dir, "events", "nation")
    rows = spark.table(f"{schema}.events").select("event_id", "user_id", "event_type", "value")
    publish.replace_table(rows, f"{schema}.by_user", Layout(sortkey="user_id"))
    replicated = Layout(diststyle="all")
    publish.replace_table(spark.table(f"{schema}.nation"), f"{schema}.small", replicated)
    small = read_table(spark, f"{schema}.small", replicated)
    return (
        spark.table(f"{schema}.by_user")
        .withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
        .join(small, "n_nationkey")
        .select("event_id", "user_id", "event_type", "value", "n_name")
    )


@query
def mv_delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through delimited files; blank texts come back NULL."""
    rows = samples.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")))
    path = f"{shared_dir(spark)}/{scratch_schema(spark)}/documents"
    write_delimited(rows, path)
    return read_delimited(spark, path, rows.schema)


@query
def mv_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A select, a Python function over its rows, a declared output, a swap."""

    def in_cents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cents = (batch["o_totalprice"] * 100).round().astype("int64")
            status = batch["o_orderstatus"].str.lower()
            yield pd.DataFrame({"order_key": batch["o_orderkey"], "status": status, "cents": cents})

    schema = _warehouse(spark, sf_dir, "orders")
    view = View(
        name=f"{schema}.order_cents",
        query=f"select o_orderkey, o_orderstatus, o_totalprice from {schema}.orders;",
        processor=in_cents,
        ddl=f"create table {schema}.order_cents(\norder_key bigint,\nstatus text encode zstd,\ncents bigint\n)",
    )
    rebuild(spark, view, _clock())
    return spark.table(view.name)


@query
def mv_rebuild_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, each over the one before, built in plan order; one of them fails its test.

    With what the catalog and the log hold of them afterwards.
    """
    schema = _warehouse(spark, sf_dir, "orders", "customer")
    views = spark.createDataFrame(
        [
            (f"{schema}.order_counts", ORDER_COUNTS.format(schema), None),
            (
                f"{schema}.totals",
                f"select o_custkey, sum(orders) as orders from {schema}.order_counts group by o_custkey",
                f"select count(*) > 0 as has_rows from {schema}.totals",
            ),
            (
                f"{schema}.refused",
                f"select orders, count(*) as customers from {schema}.totals group by orders",
                f"select min(customers) > 1000000000 as too_strict from {schema}.refused",
            ),
        ],
        "table_name string, query string, tests string",
    )
    levels = refresh.build_levels(views, lineage.dependency_edges(views))
    book, log = f"{schema}.catalog", f"{schema}.runs"
    undone = views.drop("tests").withColumn("interval", F.lit(None).cast("int")).withColumn("config", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], catalogs.CATALOG_SCHEMA)
    publish.replace_table(catalogs.apply_definitions(empty, undone, NOW), book)
    outcomes, _ = rebuild_set(
        spark, views.join(levels, "table_name"), clock=_clock(), catalog=book, log=log
    )
    logged = spark.table(log).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("logged"), F.count("tests").alias("tested")
    )
    recorded = spark.table(book).select("table_name", "times_run", "last_created", "force")
    outcomes = outcomes.join(recorded, "table_name").join(logged, "table_name")
    built = spark.table(f"{schema}.totals")
    count = built.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("orders").cast("bigint").alias("orders")
    )
    return (
        outcomes.withColumn("table_name", F.split_part("table_name", F.lit("."), F.lit(2)))
        .withColumn("failed_test", F.regexp_extract(F.coalesce("error", F.lit("")), r": (\w+)\z", 1))
        .drop("error")
        .join(count.withColumn("table_name", F.lit("totals")), "table_name", "left")
    )


ORDER_CHECKS = """
select count(*) = count(distinct o_orderkey) as unique_orders from {0}.orders;
select min(o_totalprice) > 0 as positive_prices from {0}.orders;
select max(o_totalprice) < 100 as all_cheap from {0}.orders;
select o_totalprice > 0 as no_such_order from {0}.orders where o_orderkey < 0;
select cast(null as boolean) as unknown from {0}.orders limit 1;
"""


COUNT_CHECKS = """
select min(orders) > 0 as some_orders from {0};
select sum(total) > 0 and count(*) > 1 as some_money from {0};
select max(orders) < 2 as never_again from {0};
select count(distinct o_orderstatus) = 3 as three_states from {0};
select count(*) > 0 as no_such_state from {0} where o_orderstatus = 'X';
select avg(total) as mean_is_true from {0}
"""


@query
def data_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _warehouse(spark, sf_dir, "orders")
    return expectations.run_tests(spark, ORDER_CHECKS.format(schema))


@query
def data_tests_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of a table that the write of it answers, beside those that need a statement."""
    schema = _warehouse(spark, sf_dir, "orders")
    name, seen = f"{schema}.order_counts", Observation()
    rows = publish.select_rows(spark, ORDER_COUNTS.format(schema))
    tests = expectations.observable(rows, COUNT_CHECKS.format(name), name)
    layout = Layout(distkey="o_custkey", sortkey="orders")
    candidate = publish.build_candidate(rows, name, layout, observe=lambda df: df.observe(seen, *tests.metrics.values()))
    verdicts = expectations.observed_verdicts(spark, tests.over(name, candidate), seen.get)
    return verdicts.withColumn("observed", F.col("test_name").isin(*tests.metrics))


@query
def row_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.row_expectations(
        samples.table(spark, sf_dir, "lineitem"),
        {
            "quantity_positive": F.col("l_quantity") > 0,
            "small_discount": F.col("l_discount") <= 0.05,
            "known_flag": F.col("l_returnflag").isin("A", "N", "R"),
        },
    )


def _snapshots(spark: SparkSession, sf_dir: str, keep_minutes: int | None) -> DataFrame:
    schema = _warehouse(spark, sf_dir, "orders")
    name = f"{schema}.order_counts"
    publish.replace_table(publish.select_rows(spark, ORDER_COUNTS.format(schema)), name)
    # Hour 30 comes too early: the snapshot of hour 25 is not a day old.
    for hour in (0, 25, 30, 50):
        snapshots.make_snapshot(spark, name, NOW + hour * 3600, 24 * 60, keep_minutes)
    return snapshots.read_history(spark, name).withColumn(
        "snapshot_timestamp", F.unix_seconds("snapshot_timestamp")
    )


@query
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir, None)


@query
def snapshot_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir, 30 * 60)


@query
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second snapshot of a table that has lost two columns and gained one."""
    schema = _warehouse(spark, sf_dir, "orders")
    name = f"{schema}.order_counts"
    later = f"""select o_custkey, count(*) as orders, cast(min(o_orderkey) as bigint) as first_key
        from {schema}.orders group by o_custkey"""
    for hour, text in ((0, ORDER_COUNTS.format(schema)), (25, later)):
        publish.replace_table(publish.select_rows(spark, text), name)
        snapshots.make_snapshot(spark, name, NOW + hour * 3600, 24 * 60, allow_missing=True)
    return snapshots.read_history(spark, name).withColumn(
        "snapshot_timestamp", F.unix_seconds("snapshot_timestamp")
    )


# The definition set -------------------------------------------------------------


@query
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder scanned as a whole, changed, and scanned for what has changed: all files and what became of them."""
    root = f"{shared_dir(spark)}/{scratch_schema(spark, 'folder')}/views"
    files, _ = stage(samples.files(spark, sf_dir))
    samples.write_files(files, root)
    first = manifest.scan_changes(spark, root, manifest.empty_manifest(spark))
    known, _ = stage(manifest.take_changes(files.limit(0), first))

    path, text = F.col("path"), F.col("text")
    gone = F.contains(path, F.lit("13"))
    edited = files.where(gone | F.contains(path, F.lit("7"))).select(
        "path", F.when(~gone, F.concat(text, F.lit("\n-- edited"))).alias("text")
    )
    new = files.where(F.contains(path, F.lit("42"))).select(F.concat(F.lit("more/"), path).alias("path"), "text")
    samples.write_files(edited.unionByName(new), root)
    second = manifest.scan_changes(spark, root, first.manifest)
    marks = second.files.select("path", F.when(F.col("known"), "changed").otherwise("new").alias("status"))
    marks = marks.unionByName(second.gone.select("path", F.lit("gone").alias("status")))
    return (
        manifest.take_changes(known, second)
        .join(marks, "path", "full_outer")
        .withColumn("status", F.coalesce("status", F.lit("same")))
    )


@query
def folder_replan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, what is read, and settings of all tables, brought up to date from a change set."""
    before, after = (stage(files)[0] for files in samples.folder_before_and_after(spark, sf_dir))
    state = replan.folder_state(before)
    known = before.select("path", F.lit(True).alias("known"))
    changed, _ = stage(after.exceptAll(before).join(known, "path", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    gone, _ = stage(before.join(after, "path", "left_anti").select("path"))
    new = replan.update_state(state, manifest.Changes(changed, gone, manifest.empty_manifest(spark), 0, 0))
    reads = new.edges.groupBy(F.col("src").alias("table_name")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ", ").alias("reads"))
    return (
        new.levels.withColumnRenamed("node", "table_name")
        .join(new.configs, "table_name")
        .join(reads, "table_name", "left")
        .select("table_name", "level", "config", "reads")
    )


@query
def test_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder.load_tests(folder.classify(samples.files(spark, sf_dir)))


@query
def dependency_edges_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most definitions read one table, whose rows are parted for the join."""
    return lineage.dependency_edges(samples.definitions_with_hub(spark, sf_dir), rows_per_task=100)


@query
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.edges(spark, sf_dir)


@query
def readers_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions whose text reads one table, by the predicate on each text."""
    defs = samples.definitions(spark, sf_dir)
    return defs.where(texts.mentions(F.lit("s1.t1"), F.col("query"))).select("table_name")


@query
def comment_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.definitions(spark, sf_dir).select(
        "table_name",
        texts.strip_comments(F.col("query")).alias("clean"),
        texts.trim_statement(F.col("query")).alias("statement"),
    )


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.definitions(spark, sf_dir).select(F.col("table_name").alias("node"), "interval")


@query
def graph_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.drop_attributes(_nodes(spark, sf_dir), "interval")
    return graph.sources(nodes, samples.edges(spark, sf_dir))


@query
def sources_without_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.sources_without(_nodes(spark, sf_dir), samples.edges(spark, sf_dir), "interval")
    return found.select("node")


@query
def graph_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degrees(samples.edges(spark, sf_dir))


@query
def graph_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.children(_nodes(spark, sf_dir), samples.edges(spark, sf_dir), "s9.t99")


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = samples.catalog(spark, sf_dir).where("started IS NOT NULL")
    return running.select(F.col("table_name").alias("node"))


@query
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(samples.edges(spark, sf_dir), _running(spark, sf_dir))


@query
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(samples.edges_with_cycles(spark, sf_dir))
    return found.select(F.array_join("cycle", " > ").alias("cycle"), "length")


@query
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and levels of a graph with a core where each of 50 tables reads all of them."""
    return graph.condensed_levels(_nodes(spark, sf_dir), samples.edges_with_core(spark, sf_dir))


@query
def force_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.reachable(samples.edges(spark, sf_dir), _running(spark, sf_dir))
    forced = refresh.force_propagation(samples.catalog(spark, sf_dir), reached)
    return forced.select("table_name", "force")


@query
def definition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = folder.classify(samples.files(spark, sf_dir))
    return known.select(
        "path", "kind", "table_name", times.interval_minutes(F.col("interval")).alias("minutes")
    )


@query
def definitions_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder.load_definitions(folder.classify(samples.files(spark, sf_dir)))


@query
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions for the tables in the run log; some have none."""
    wanted = samples.runs(spark, sf_dir).select("table_name").distinct()
    defs = folder.load_definitions(folder.classify(samples.files(spark, sf_dir)))
    return folder.find_definitions(defs, wanted).select("table_name", "interval", "found")


@query
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_files(folder.classify(samples.files(spark, sf_dir)))


@query
def missing_files_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_files_report(folder.classify(samples.files(spark, sf_dir)))


@query
def layout_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = samples.definitions(spark, sf_dir)
    return checks.unknown_layout_keys(defs, folder.decode_config(F.col("config")))


@query
def layout_column_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check against known columns instead of the text."""
    defs = samples.definitions(spark, sf_dir)
    keys = checks.declared_keys(defs, folder.decode_config(F.col("config")))
    columns = defs.select(
        "table_name",
        F.explode(F.array(F.lit("id"), F.concat(F.lit("v"), (F.col("k") % 4).cast("string")))).alias("key"),
    )
    return checks.unknown_layout_columns(keys.select("table_name", "setting", "key"), columns)


@query
def config_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = folder.decode_config(F.col("config"))
    return samples.definitions(spark, sf_dir).select(
        "table_name",
        config["distkey"].alias("distkey"),
        config["sortkey"].alias("sortkey"),
        folder.encode_config(config).alias("encoded"),
    )


# Settings -----------------------------------------------------------------------


@query
def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.effective_settings(samples.settings(spark, sf_dir))


@query
def effective_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = settings.effective_grants(samples.acl(spark, sf_dir))
    return grants.select("table_name", settings.grant_text(F.col("grantees")).alias("grantees"))


@query
def scoped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder-wide, schema and table settings brought to every table."""
    defs, k = samples.definitions(spark, sf_dir), F.col("k")
    folder_wide = samples.table(spark, sf_dir, "region").agg(
        F.lit("").alias("scope"), F.lit(0).alias("level"), F.max(F.lit("all")).alias("value")
    )
    schemas = defs.groupBy(F.split_part("table_name", F.lit("."), F.lit(1)).alias("scope")).agg(
        F.lit(1).alias("level"), F.max(F.when(k % 10 < 5, "even")).alias("value")
    )
    own = F.when(k % 12 == 0, "null").when(k % 6 == 0, "key")
    tables = defs.select(F.col("table_name").alias("scope"), F.lit(4).alias("level"), own.alias("value"))
    rows = folder_wide.unionByName(schemas).unionByName(tables).where("value IS NOT NULL")
    configured = settings.table_configs(
        defs.select("table_name"), rows.withColumn("key", F.lit("diststyle"))
    )
    return configured.select("table_name", F.col("config")["diststyle"].alias("diststyle"))


# The catalog --------------------------------------------------------------------


@query
def definition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.definition_diff(
        samples.catalog(spark, sf_dir), samples.changed_definitions(spark, sf_dir)
    )


@query
def definition_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after the change: times of deletion and flags of all tables."""
    after = catalogs.apply_definitions(
        samples.catalog(spark, sf_dir), samples.changed_definitions(spark, sf_dir), NOW
    )
    return after.select("table_name", "interval", "mean", "times_run", "force", "started", "deleted", "waiting")


@query
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.diff_summary(definition_diff(spark, sf_dir))


@query
def change_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.change_notice(definition_diff(spark, sf_dir))


@query
def flag_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables seen in the run log start, those with a processed run wait, all lose their force flag."""
    runs = samples.runs(spark, sf_dir)
    changed = samples.customer_catalog(spark, sf_dir)
    changed = catalogs.set_flag(changed, "started", NOW, runs.select("table_name"))
    changed = catalogs.mark_waiting(changed, runs.where("`insert` IS NOT NULL"), NOW)
    changed = catalogs.clear_waiting(changed, runs.where("make_snapshot IS NOT NULL"))
    changed = catalogs.set_flag(changed, "force", None)
    return changed.select("table_name", "started", "waiting", "force")


@query
def recorded_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log's finished runs folded into the catalog's means and counts."""
    runs = samples.runs(spark, sf_dir).where("finish IS NOT NULL")
    finished = runs.select("table_name", "start", runlog.duration().alias("duration"))
    after = catalogs.record_builds(samples.customer_catalog(spark, sf_dir), finished)
    return after.select(
        "table_name", "last_created", F.round("mean", 6).alias("mean"), "times_run", "force", "started", "waiting"
    )


@query
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.catalog_listing(samples.customer_catalog(spark, sf_dir), NOW)


# What is due --------------------------------------------------------------------


@query
def refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.refresh_queue(samples.customer_catalog(spark, sf_dir), NOW)


@query
def refresh_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.refresh_decision(samples.customer_catalog(spark, sf_dir), NOW)


@query
def waiting_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.waiting_status(samples.customer_catalog(spark, sf_dir), NOW)


@query
def overdue_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.overdue_runs(samples.customer_catalog(spark, sf_dir), NOW)


@query
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.refresh_plan(samples.catalog(spark, sf_dir), samples.edges(spark, sf_dir), NOW)


# The run log --------------------------------------------------------------------


@query
def run_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log table, read back."""
    log = f"{scratch_schema(spark)}.run_log"
    runs = samples.runs(spark, sf_dir)
    runlog.append_runs(runs.where("finish IS NULL"), log)
    runlog.append_runs(runs.where("finish IS NOT NULL"), log)
    return spark.table(log)


@query
def overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.overview_stats(samples.runs(spark, sf_dir), NOW, 240)


@query
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.running_means(samples.runs(spark, sf_dir))


@query
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.table_stats(samples.runs(spark, sf_dir))


@query
def jobs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = runlog.jobs(
        samples.runs(spark, sf_dir), samples.customer_catalog(spark, sf_dir), NOW - 20 * 86400, NOW - 86400
    )
    return runlog.job_texts(listed)


@query
def table_details_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 20 runs of each table."""
    catalog = samples.customer_catalog(spark, sf_dir)
    return runlog.latest_runs(catalog, samples.runs(spark, sf_dir).drop("run_id"), 20).select(
        "table_name", "interval", "start", "finish", "rank"
    )


@query
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = runlog.step_durations(samples.runs(spark, sf_dir), ["run_id", "table_name"])
    return steps.select("run_id", "table_name", "step_no", "step", "at", "seconds")


@query
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = runlog.step_durations(samples.runs(spark, sf_dir), ["run_id"])
    return runlog.step_texts(steps).select("run_id", "step_no", "line")


@query
def duration_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.duration_series(samples.runs(spark, sf_dir), ["run_id", "table_name"])


@query
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at least a day apart."""
    events = samples.table(spark, sf_dir, "events")
    kept = throttle(events, ["user_id"], "ts", 86400, tie_break="event_id")
    return kept.select("event_id", "user_id", times.epoch_micros(events, "ts").alias("at"))


@query
def throttled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, read as a stream until its end and written to files."""
    events = samples.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(sf_dir, pathGlobFilter="events.parquet")
    folder = f"{shared_dir(spark)}/{scratch_schema(spark, 'stream')}"
    running = (
        throttle_stream(stream, ["user_id"], "ts", 86400)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/kept")
    )
    running.awaitTermination()
    kept = spark.read.parquet(f"{folder}/kept")
    return kept.select("user_id", times.epoch_micros(kept, "ts").alias("at"))


# Scalars ------------------------------------------------------------------------


@query
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("o_totalprice").cast("bigint")
    return samples.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        times.duration_text(seconds).alias("duration"),
        times.minutes_text(seconds).alias("minutes"),
        times.interval_text(F.col("o_custkey")).alias("interval_text"),
        times.mean_text(F.col("o_totalprice") / 50).alias("mean_text"),
    )


@query
def interval_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in "mhdwMH"]), (F.col("p_partkey") % 6 + 1).cast("int"))
    literal = F.concat(F.col("p_size").cast("string"), unit)
    return samples.table(spark, sf_dir, "part").select(
        "p_partkey",
        times.interval_minutes(F.when(F.col("p_partkey") % 7 != 0, literal)).alias("minutes"),
        times.interval_minutes(F.col("p_type"), strict=False).alias("not_an_interval"),
    )


@query
def epoch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = samples.table(spark, sf_dir, "events")
    at = F.when(F.col("event_type") != "error", times.epoch_seconds(events, "ts"))
    return events.select(
        "event_id",
        times.long_text(at).alias("long_text"),
        times.clock_text(at).alias("clock"),
        times.date_text(at).alias("iso"),
        times.age_text(at, NOW).alias("age"),
        texts.blank_if_null(F.when(F.col("event_type") == "view", F.col("event_type"))).alias("blank"),
    )


@query
def age_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages from seconds to years, on both sides of now."""
    k = F.col("o_orderkey")
    at = (F.lit(NOW) - (k % 3 - 1) * (k * k % 100_000_007)).cast("bigint")
    return samples.table(spark, sf_dir, "orders").select("o_orderkey", times.age_text(at, NOW).alias("age"))


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


