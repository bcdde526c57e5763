"""Rebuild one table, or a set of tables in plan order."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from freshet.functions.times import interval_minutes
from freshet.operators import lineage, snapshots, versions
from freshet.operators.catalog import record_builds
from freshet.operators.expectations import DataTestsFailed, Observed, observable, observed_verdicts, verdict
from freshet.operators.layout import Layout
from freshet.operators.processors import Processor, process_query
from freshet.operators.publish import (
    build_candidate,
    drop_previous,
    publish,
    replace_table,
    select_rows,
)
from freshet.operators.runlog import RUN_SCHEMA, STEP_COLUMNS, append_runs, duration, finish_time
from freshet.session import stage
from freshet.sources.definitions import declared_schema, decode_config, load_ddl, load_tests


class View(NamedTuple):
    """What a rebuild needs to know about one table."""

    name: str
    query: str
    config: dict | None = None
    tests: str | None = None
    processor: Processor | None = None
    ddl: str | None = None
    snapshot_minutes: int | None = None
    keep_minutes: int | None = None
    # Published by a pointer, with so many old versions kept; by renaming, if not given.
    keep_versions: int | None = None


Clock = Callable[[], int]


def wall_clock() -> int:
    return int(time.time())


def rebuild(spark: SparkSession, view: View, clock: Clock = wall_clock, run: dict | None = None) -> dict:
    """Build, test, publish and snapshot one table; returns its run-log row.

    If a data test fails, or a view over the table would not resolve any more, the
    candidate is dropped, the live table stays as it is, and ``DataTestsFailed`` or
    ``DependentsBroken`` tells which.  Views over a table whose columns changed are
    re-created after the swap.  A given ``run`` gets the steps as they end, so it also
    tells how far a failed rebuild came.
    """
    run = {} if run is None else run
    run.update(dict.fromkeys(STEP_COLUMNS))

    def log(step: str) -> None:
        run[step] = clock()

    log("start")
    log("connect")
    layout, grantees = Layout.from_config(view.config), (view.config or {}).get("grant_select")
    pointed = view.keep_versions is not None

    seen, tests = Observation(), Observed({}, {}, "")

    def build(rows: DataFrame) -> str:
        nonlocal tests
        tests = observable(rows, view.tests or "", view.name)

        def observe(laid: DataFrame) -> DataFrame:
            return laid.observe(seen, *tests.metrics.values()) if tests.metrics else laid

        if pointed:
            return versions.version_name(view.name, versions.build_version(rows, view.name, layout, grantees, observe))
        return build_candidate(rows, view.name, layout, grantees, observe)

    if view.processor is not None:
        candidate = build(process_query(spark, view.query, view.processor, declared_schema(view.ddl or "")))
        # Selecting, processing and loading are one Spark job, so they end together.
        for step in ("select", "process", "insert"):
            log(step)
    else:
        candidate = build(select_rows(spark, view.query))
        log("create_temp")

    try:
        if view.tests:
            # Tests that the write has answered need no scan of the candidate.
            told = seen.get if tests.metrics else {}
            passed, failed = verdict(observed_verdicts(spark, tests.over(view.name, candidate), told))
            if not passed:
                raise DataTestsFailed(view.name, failed)
        log("tests")
        # Views can only break, or have to follow, where columns change.
        changed = columns_change(spark, view.name, candidate)
        dependents = lineage.check_dependents(spark, view.name, candidate) if changed else []
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {candidate}")
        raise

    if pointed:
        versions.recover(spark, view.name)
        versions.point(spark, view.name, int(candidate.rsplit("v", 1)[1]))
    else:
        publish(spark, view.name)
    lineage.recreate_views(spark, dependents)
    log("replace_old")
    if pointed:
        versions.retire(spark, view.name, view.keep_versions)
    else:
        drop_previous(spark, view.name)
    log("drop_old")
    if view.snapshot_minutes and snapshots.make_snapshot(
        spark, view.name, run["start"], view.snapshot_minutes, view.keep_minutes
    ):
        log("make_snapshot")
    run["finish"] = finish_time(run)
    return {"table_name": view.name, **run}


def columns_change(spark: SparkSession, name: str, candidate: str) -> bool:
    """Whether the candidate's columns differ from those of the live table, if there is one."""

    def columns(table: str) -> list[tuple]:
        return [(f.name, f.dataType.simpleString()) for f in spark.table(table).schema]

    return spark.catalog.tableExists(name) and columns(name) != columns(candidate)


def views_to_build(plan: DataFrame, catalog: DataFrame, classified: DataFrame) -> DataFrame:
    """The plan's tables with all that ``rebuild_set`` needs, from the catalog and the files."""
    config = decode_config(F.col("config"))
    known = catalog.select("table_name", "query", config.alias("config"))
    tests = load_tests(classified).withColumnRenamed("text", "tests")
    ddl = load_ddl(classified).withColumnRenamed("text", "ddl")
    return (
        plan.select("table_name", "level")
        .join(known, "table_name")
        .join(tests, "table_name", "left")
        .join(ddl, "table_name", "left")
        .withColumn("snapshot_minutes", interval_minutes(F.col("config")["snapshots_interval"]))
        .withColumn("keep_minutes", interval_minutes(F.col("config")["snapshots_stored_for"]))
    )


def record_runs(runs: DataFrame, catalog: str | None, log: str | None) -> None:
    """Append runs to the log, then fold the finished ones into the catalog; either may be left out."""
    if log:
        append_runs(runs, log)
    if catalog:
        finished = runs.where("finish IS NOT NULL").select("table_name", "start", duration().alias("duration"))
        replace_table(record_builds(runs.sparkSession.table(catalog), finished), catalog)


def rebuild_set(
    spark: SparkSession,
    views: DataFrame,
    processors: dict[str, Processor] | None = None,
    clock: Clock = wall_clock,
    at_once: int = 4,
    catalog: str | None = None,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rebuild ``views`` level by level; returns ``(outcomes, runs)``.

    ``views`` has ``table_name, level, query`` and may have ``config`` (a map),
    ``tests``, ``ddl``, ``snapshot_minutes`` and ``keep_minutes``.  Tables of a
    level are independent, so a few are built at once.  A failed table does not
    stop those above it.  Outcomes are ``(table_name, level, status, error)``; runs of
    failed tables end with the last step they took.

    As each level ends its runs are appended to the table ``log`` and the finished ones
    folded into the table ``catalog``, so a lost driver loses the record of a level at most.
    """
    processors = processors or {}
    views, _ = stage(views)
    fields = [f for f in View._fields if f in views.columns]

    def attempt(row) -> tuple[tuple, tuple]:
        run: dict = {}
        view = View(
            name=row.table_name,
            processor=processors.get(row.table_name),
            **{f: row[f] for f in fields if row[f] is not None},
        )
        try:
            rebuild(spark, view, clock, run)
            outcome = (view.name, row.level, "built", None)
        except Exception as error:  # any failure of one table is an outcome, not the end
            outcome = (view.name, row.level, "failed", str(error))
        return outcome, (view.name, *(run.get(c) for c in STEP_COLUMNS))

    outcomes, runs = [], []
    levels = [r.level for r in views.select("level").distinct().orderBy("level").toLocalIterator()]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for level in levels:
            rows = views.where(F.col("level") == level).orderBy("table_name").toLocalIterator()
            done = list(pool.map(attempt, rows))
            outcomes += [outcome for outcome, _ in done]
            runs += [run for _, run in done]
            record_runs(spark.createDataFrame([run for _, run in done], RUN_SCHEMA), catalog, log)
    return (
        spark.createDataFrame(outcomes, "table_name string, level int, status string, error string"),
        spark.createDataFrame(runs, RUN_SCHEMA),
    )
