"""Definition sets, catalogs and run logs derived from the sample tables by formula.

The formulas are mirrored in SQL in ``oracle.py``; both work on whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from freshet.functions.times import epoch_seconds
from freshet.operators.lineage import dependency_edges
from freshet.sources.definitions import FILES_PER_TASK

# 2024-01-31 00:00:00 UTC, just after the last sample event.
NOW = 1706659200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mod(column: Column, by: int) -> Column:
    return F.pmod(column, F.lit(by))


def half(column: Column, by: int) -> Column:
    return F.call_function("div", column, F.lit(by))


def name_of(key: Column) -> Column:
    return F.concat(F.lit("s"), mod(key, 10).cast("string"), F.lit(".t"), key.cast("string"))


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit("."), F.lit('"."')), F.lit('"'))


def definition_text(k: Column) -> Column:
    """A select over two other definitions, with a comment that names a third."""
    one, two = name_of(half(k, 2)), name_of(half(k, 3))
    one = F.when(mod(k, 3) == 0, quoted(one)).otherwise(one)
    listed = F.when(mod(k, 11) == 0, "*").otherwise(
        F.concat(F.lit("a.id, a.v"), mod(k, 4).cast("string"))
    )
    text = F.concat(
        F.lit("select "), listed, F.lit("\nfrom "), one, F.lit(" a\n\njoin "), quoted(two),
        F.lit(" b on a.id = b.id -- not "), name_of(k + 1), F.lit("\nwhere b.id > 0;\n"),
    )
    return F.when(k < 2, F.lit("select 1 as id")).otherwise(text)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, table_name, query, interval, config)``, one per part."""
    k = F.col("p_partkey")
    minutes = mod(k, 5) * 360
    distkey = F.when(mod(k, 2) == 0, F.concat(F.lit("v"), mod(k, 3).cast("string")))
    sortkey = F.when(mod(k, 3) == 0, F.lit("id")).when(mod(k, 3) == 1, F.lit("day"))
    config = F.to_json(F.struct(distkey.alias("distkey"), sortkey.alias("sortkey")))
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        name_of(k).alias("table_name"),
        definition_text(k).alias("query"),
        F.when(minutes != 0, minutes).cast("int").alias("interval"),
        F.when(distkey.isNotNull() | sortkey.isNotNull(), config).alias("config"),
    )


def changed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next definition set: some are gone, some changed, some new."""
    k = F.col("k")
    kept = definitions(spark, sf_dir).where(mod(k, 13) != 0)
    changed = kept.withColumn(
        "query", F.when(mod(k, 7) == 0, F.concat("query", F.lit("\nlimit 10"))).otherwise(F.col("query"))
    ).withColumn("interval", F.when(mod(k, 10) == 3, 30).otherwise(F.col("interval")))
    added = (
        definitions(spark, sf_dir)
        .where(mod(k, 9) == 0)
        .withColumn("table_name", F.concat("table_name", F.lit("_next")))
    )
    return changed.unionByName(added).drop("k")


def definitions_with_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_name, query)``: two thirds of the definitions read one and the same table."""
    k = F.col("p_partkey")
    reads = F.concat(F.lit("select 1 as id from s0.t0, "), name_of(half(k, 2)))
    text = F.when(mod(k, 3) != 0, reads).otherwise("select 1 as id")
    return table(spark, sf_dir, "part").select(name_of(k).alias("table_name"), text.alias("query"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency graph of the definitions, by the lineage operator."""
    return dependency_edges(definitions(spark, sf_dir))


def edges_with_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph plus an edge back to every 97th definition from the first it reads."""
    k = F.col("k")
    back = (
        definitions(spark, sf_dir)
        .where((k > 0) & (mod(k, 97) == 0))
        .select(name_of(half(k, 2)).alias("src"), F.col("table_name").alias("dst"))
    )
    return edges(spark, sf_dir).unionByName(back)


def edges_with_core(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """The same, and the first ``width`` definitions each read all of these."""
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")))
    core = definitions(spark, sf_dir).where(F.col("k") < width).select(F.col("table_name").alias("src"), others.alias("to"))
    return edges_with_cycles(spark, sf_dir).unionByName(core.select("src", name_of(F.col("to")).alias("dst")))


def catalog_of(keys: DataFrame) -> DataFrame:
    """A catalog over ``(k, table_name, query, interval, config)``."""
    k = F.col("k")
    now = F.lit(NOW)

    def some(by: int, value: Column, *others: tuple[int, Column]) -> Column:
        column = F.when(mod(k, by) == 0, value)
        for rest, other in others:
            column = column.when(mod(k, by) == rest, other)
        return column

    zero = F.lit(0)
    return keys.select(
        "table_name",
        "query",
        "interval",
        "config",
        F.when(mod(k, 6) != 0, now - mod(k, 5000) * 60 - mod(k, 60)).cast("bigint").alias("last_created"),
        mod(k, 300).cast("double").alias("mean"),
        mod(k, 40).cast("int").alias("times_run"),
        some(9, F.lit(1), (1, zero)).cast("int").alias("force"),
        some(13, now - mod(k, 4000)).cast("bigint").alias("started"),
        some(17, now - mod(k, 20) * 86400, (1, zero)).cast("bigint").alias("deleted"),
        some(19, now - mod(k, 10000), (1, zero)).cast("bigint").alias("waiting"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the definitions."""
    return catalog_of(definitions(spark, sf_dir))


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with one table per customer; its names match the run log's."""
    k = F.col("c_custkey")
    interval = F.when(mod(k, 4) == 1, 60).when(mod(k, 4) == 2, 1440).when(mod(k, 4) == 3, 30)
    keys = table(spark, sf_dir, "customer").select(
        k.alias("k"),
        name_of(k).alias("table_name"),
        F.concat(F.lit("select * from base."), F.lower("c_mktsegment")).alias("query"),
        interval.cast("int").alias("interval"),
        F.lit(None).cast("string").alias("config"),
    )
    return catalog_of(keys)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, table_name, steps...)``, one per event; runs on error events stop at the tests."""
    events = table(spark, sf_dir, "events")
    e, user = F.col("event_id"), F.col("user_id")
    events = events.withColumn("start", epoch_seconds(events, "ts"))
    start = F.col("start")
    processed, done = mod(e, 4) == 0, F.col("event_type") != "error"

    def at(base: int, spread: int, when: Column | None = None) -> Column:
        value = start + base + mod(e, spread)
        return (value if when is None else F.when(when, value)).cast("bigint")

    never = F.lit(None).cast("bigint")
    steps = {
        "start": start,
        "connect": at(0, 3),
        "select": at(5, 7, processed),
        "create_temp": at(10, 11, ~processed),
        "process": at(20, 13, processed),
        "csv": never,
        "s3": never,
        "insert": at(40, 17, processed),
        "clean_csv": never,
        "tests": at(60, 19, done),
        "replace_old": at(90, 5, done),
        "drop_old": at(95, 23, done),
        "make_snapshot": at(130, 29, done & (mod(e, 6) == 0)),
        "finish": at(95, 23, done),
    }
    return events.select(
        e.alias("run_id"),
        name_of(user).alias("table_name"),
        *[column.alias(name) for name, column in steps.items()],
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_name, level, key, value)``: up to three keys on five levels per supplier."""
    k, level, j = F.col("s_suppkey"), F.col("level"), F.col("j")
    pick = mod(k * 3 + level * 5 + j * 7 + half(k, 10), 6)
    key = F.element_at(F.array(F.lit("distkey"), F.lit("sortkey"), F.lit("diststyle")), j + 1)
    value = (
        F.when(pick == 0, F.lit("null"))
        .when(pick == 1, F.lit(""))
        .when(pick == 2, F.concat(F.lit("col"), level.cast("string")))
        .when(pick == 3, F.concat(F.lit("c"), mod(k, 7).cast("string")))
    )
    levels = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level")
    )
    return (
        levels.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
        .where(pick < 4)
        .select(name_of(k).alias("table_name"), "level", key.alias("key"), value.alias("value"))
    )


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_name, level, value)``: a grant setting per supplier and level."""
    k, level = F.col("s_suppkey"), F.col("level")
    pick = mod(k + level + half(k, 6) * level, 6)
    value = (
        F.when(pick == 1, "ann, bob")
        .when(pick == 2, "+cy")
        .when(pick == 3, "-ann")
        .when(pick == 4, "+dan, -bob")
        .when(pick == 5, "")
    )
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
        .select(name_of(k).alias("table_name"), "level", value.alias("value"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, text)`` of a definition folder with gaps: queries, tests, processors, selects."""
    k = F.col("p_partkey")
    schema, short = mod(k, 10).cast("string"), F.concat(F.lit("t"), k.cast("string"))
    inside = F.concat(F.lit("s"), schema, F.lit("/"), short)
    beside = F.concat(F.lit("s"), schema, F.lit("."), short)
    query_path = (
        F.when(mod(k, 4) == 0, F.concat(inside, F.lit(".sql")))
        .when(mod(k, 4) == 1, F.concat(beside, F.lit(" — 24h.sql")))
        .when(mod(k, 4) == 2, F.concat(inside, F.lit(" - 30m.sql")))
        .otherwise(F.concat(inside, F.lit("–1W.sql")))
    )

    def file(there: Column, path: Column, text: str | Column) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(there, F.struct(path.alias("path"), text.alias("text")))

    select_text = F.when(mod(k, 30) == 0, "").otherwise("select id from s1.t1")
    every = F.array(
        file(mod(k, 12) != 7, query_path, "select 1 as id"),
        file(mod(k, 3) == 1, F.concat(inside, F.lit("_test.sql")), "select true as ok"),
        file(mod(k, 5) == 0, F.concat(inside, F.lit(".py")), "pass"),
        file((mod(k, 10) == 0) | (mod(k, 14) == 7), F.concat(beside, F.lit("_select.sql")), select_text),
        file(mod(k, 25) == 0, F.concat(inside, F.lit("_requirements.txt")), "x==1"),
    )
    return table(spark, sf_dir, "part").select(F.inline(F.array_compact(every)))


def folder_before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(path, text)`` of a folder of definitions and schema settings, at two times.

    Later some definitions are there that others have named already, some are gone, some read
    other tables, and settings have come, gone and changed.
    """
    k = F.col("p_partkey")
    parts, path = table(spark, sf_dir, "part"), F.concat(F.replace(name_of(k), F.lit("."), F.lit("/")), F.lit(" - 6h.sql"))
    before = parts.where(mod(k, 11) != 4).select(path.alias("path"), definition_text(k).alias("text"))
    changed = F.when(mod(k, 7) == 3, definition_text(half(k, 2))).otherwise(definition_text(k))
    after = parts.where(mod(k, 13) != 5).select(path.alias("path"), changed.alias("text"))
    follower = F.concat(F.replace(name_of(k), F.lit("."), F.lit("/")), F.lit("_next.sql"))
    added = parts.where(mod(k, 9) == 0).select(follower.alias("path"), F.concat(F.lit("select id from "), name_of(k)).alias("text"))

    digit = mod(k, 10)
    schemas = parts.groupBy(digit.cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    conf, d = F.concat(F.lit("s"), F.col("d").cast("string"), F.lit(".conf")), F.col("d")
    settings_before = schemas.where(d % 3 == 0).select(conf.alias("path"), F.lit("diststyle=all").alias("text"))
    style = F.when(d == 3, "diststyle=even").otherwise("diststyle=all")
    settings_after = schemas.where((d % 3 == 0) & (d != 6) | (d == 4)).select(conf.alias("path"), style.alias("text"))
    return before.unionByName(settings_before), after.unionByName(added).unionByName(settings_after)


def write_files(files: DataFrame, root: str) -> None:
    """Write ``(path, text)`` rows as files below a folder that all executors share; a null text removes."""

    def write(rows: Iterator[Row]) -> None:
        store, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        for row in rows:
            place = f"{base}/{row.path}"
            if row.text is None:
                store.delete_file(place)
                continue
            store.create_dir(place.rpartition("/")[0], recursive=True)
            with store.open_output_stream(place) as file:
                file.write(row.text.encode())

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(files.count() / FILES_PER_TASK))
    files.repartition(tasks).foreachPartition(write)
