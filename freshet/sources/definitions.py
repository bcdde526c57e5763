"""A folder of definition files as DataFrames.

``files`` below always means ``(path, text)`` with paths relative to the folder.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from freshet.functions.text import (
    REQUIREMENTS_ENDING,
    SELECT_ENDING,
    TEST_ENDING,
    file_interval,
    file_table_name,
    strip_lines,
)
from freshet.functions.times import interval_minutes
from freshet.session import stage_sized as stage

# Settings layers, weakest first.
GLOBAL, SCHEMA_OUTSIDE, SCHEMA_INSIDE, TABLE_OUTSIDE, TABLE_INSIDE = range(5)
GLOBAL_SETTINGS = "global"


FILE_KINDS = (".sql", ".py", ".conf", ".txt")

# About as many files as a task opens, and rows as it hands on at once.
FILES_PER_TASK = 10_000
_ROWS = 1_000
# A batch of texts ends at so many bytes, or after one text.
_BATCH_BYTES = 4_000_000


def _absolute(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and place that Spark would give it; a local one as a plain path."""
    if "://" not in root and not root.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        if default and not default.startswith("file:"):
            return f"{default.rstrip('/')}/{root.lstrip('/')}".rstrip("/")
        return os.path.abspath(root)
    return re.sub(r"\Afile:/+", "/", root).rstrip("/") or "/"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """``(name, is a folder, length, nanoseconds of change)`` of what a folder holds."""
    if root.startswith("/"):
        # One by one: a folder may hold millions of files.
        with os.scandir(f"{root}/{folder}") as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.name, True, 0, 0
                elif entry.is_file():
                    about = entry.stat()
                    yield entry.name, False, about.st_size, about.st_mtime_ns
        return
    store, base = fs.FileSystem.from_uri(root)
    for entry in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
        is_folder = entry.type == fs.FileType.Directory
        if is_folder or entry.is_file:
            yield entry.base_name, is_folder, entry.size or 0, entry.mtime_ns or 0


def _tasks(spark: SparkSession, n: int, per_task: int) -> int:
    """Tasks for ``n`` files or folders: all cores, and more if each would get more than ``per_task``."""
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, math.ceil(n / per_task))))


def list_files(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """Stored ``(path, length, modified)`` of every definition file below ``root``, and their number.

    Tasks list the folders, one round for each depth, so the driver holds no names.  Hidden and
    empty files count as not there.
    """
    place = _absolute(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bool, int, int]] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            rows.clear()
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "folder", "length", "changed"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    for name, is_folder, length, changed in _entries(place, folder):
                        if not _hidden(name) and (is_folder or (length and name.endswith(FILE_KINDS))):
                            rows.append((f"{folder}/{name}" if folder else name, is_folder, length, changed))
                            if len(rows) >= _ROWS:
                                yield made()
                except FileNotFoundError:
                    # A folder may go while others are listed; the one asked for has to be there.
                    if not folder:
                        raise
        yield made()

    folders, n = spark.createDataFrame([("",)], "path string"), 1
    n_files, found = 0, []
    while n:
        listed = folders.repartition(_tasks(spark, n, _ROWS)).mapInArrow(run, "path string, folder boolean, length long, changed long")
        entries, n_here = stage(listed)
        folders = entries.where("folder").select("path")
        n = folders.count()
        n_files += n_here - n
        # Spark's own listings give whole milliseconds.
        modified = F.timestamp_millis(F.floor(F.col("changed") / 1_000_000))
        found.append(entries.where("NOT folder").select("path", "length", modified.alias("modified")))
    return reduce(DataFrame.unionByName, found), n_files


def read_files(spark: SparkSession, root: str, files: DataFrame, n: int, per_task: int = FILES_PER_TASK) -> DataFrame:
    """``(path, text)`` of ``n`` rows ``files(path)`` below ``root``, lines trimmed; tasks open them."""
    place = _absolute(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (None, place) if place.startswith("/") else fs.FileSystem.from_uri(place)
        paths: list[str] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "text"])
            paths.clear()
            texts.clear()
            return batch

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}") if store else open(f"{base}/{path}", "rb") as file:
                    text = file.read()
                paths.append(path)
                texts.append(text)
                size += len(text)
                if len(paths) >= _ROWS or size >= _BATCH_BYTES:
                    yield made()
                    size = 0
        yield made()

    opened = files.select("path").repartition(_tasks(spark, n, per_task)).mapInArrow(run, "path string, text binary")
    return opened.select("path", strip_lines(F.col("text").cast("string")).alias("text"))


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every definition file under ``root`` with its text, lines trimmed."""
    return read_files(spark, root, *list_files(spark, root))


def _ends(path: Column, ending: str) -> Column:
    return F.endswith(path, F.lit(ending))


def _cut(name: Column, ending: str) -> Column:
    return F.regexp_replace(name, re.escape(ending) + r"\z", "")


def _roughly(files: DataFrame) -> DataFrame:
    """Add ``file_table``, ``rough_kind`` and ``table_name`` as far as the path alone tells them."""
    path = F.col("path")
    settings, requirements = _ends(path, ".conf"), _ends(path, REQUIREMENTS_ENDING)
    known = F.rlike(path, F.lit(r"\.(?:sql|py|conf)\z")) | requirements
    named = files.where(known).withColumn(
        "file_table",
        F.when(requirements, file_table_name(path, strict=False)).when(
            ~settings, file_table_name(path)
        ),
    ).withColumn(
        "rough_kind",
        F.when(settings, "settings")
        .when(_ends(path, ".py"), "processor")
        .when(requirements, "requirements")
        .when(_ends(path, f"{TEST_ENDING}.sql"), "test")
        .when(_ends(path, f"{SELECT_ENDING}.sql"), "select")
        .when(_ends(path, ".sql"), "query"),
    )
    return named.withColumn(
        "table_name",
        F.when(F.col("rough_kind") == "test", _cut(F.col("file_table"), TEST_ENDING))
        .when(F.col("rough_kind") == "select", _cut(F.col("file_table"), SELECT_ENDING))
        .when(F.col("rough_kind") == "requirements", _cut(F.col("file_table"), "_requirements"))
        .otherwise(F.col("file_table")),
    )


def tables_of_files(files: DataFrame) -> DataFrame:
    """``(path, belongs_to)``: the table whose files have to be classified together."""
    return _roughly(files).select("path", F.col("table_name").alias("belongs_to"))


def classify(files: DataFrame) -> DataFrame:
    """Add ``kind``, ``table_name``, ``interval`` (the literal) and ``place``.

    Kinds: query, ddl (declares a processor's output), select (a processor's
    input), test, processor, requirements, settings.  ``place`` ranks two files of
    one kind for a table: 0 in the schema's folder, 1 beside it, 2 elsewhere.
    """
    named, path = _roughly(files), F.col("path")
    processors = (
        named.where("rough_kind = 'processor'")
        .select("table_name", F.lit(True).alias("processed"))
        .distinct()
    )
    kind = (
        F.when((F.col("rough_kind") == "query") & F.col("processed"), "ddl")
        # Without a processor a file with the select ending is a definition of that name.
        .when((F.col("rough_kind") == "select") & F.col("processed").isNull(), "query")
        .otherwise(F.col("rough_kind"))
    )
    plain_select = (F.col("rough_kind") == "select") & F.col("processed").isNull()
    table_name = F.when(plain_select, F.col("file_table")).otherwise(F.col("table_name"))
    schema, table = F.split_part(table_name, F.lit("."), F.lit(1)), F.split_part(table_name, F.lit("."), F.lit(2))
    return named.join(processors, "table_name", "left").select(
        "path",
        "text",
        kind.alias("kind"),
        table_name.alias("table_name"),
        F.when(kind.isin("query", "ddl"), file_interval(path)).alias("interval"),
        F.when(F.startswith(path, F.concat(schema, F.lit("/"), table)), 0)
        .when(F.startswith(path, table_name), 1)
        .otherwise(2)
        .alias("place"),
    )


def preferred_text(classified: DataFrame, *kinds: str) -> DataFrame:
    """One text per table among files of the given kinds, the best placed one."""
    return (
        classified.where(F.col("kind").isin(*kinds))
        .groupBy("table_name")
        .agg(F.min_by("text", F.struct("place", "path")).alias("text"))
    )


def load_definitions(classified: DataFrame) -> DataFrame:
    """``(table_name, query, interval)``: interval in minutes from the file name.

    A table with a processor takes its query from the processor's select.
    """
    own = (
        classified.where(F.col("kind").isin("query", "ddl"))
        .groupBy("table_name")
        .agg(
            F.min_by(F.struct("kind", "text", "interval"), F.struct("place", "path")).alias("f")
        )
        .select("table_name", "f.*")
    )
    selects = preferred_text(classified, "select").withColumnRenamed("text", "select_text")
    query = F.when(F.col("kind") == "ddl", F.col("select_text")).otherwise(F.col("text"))
    return own.join(selects, "table_name", "left").select(
        "table_name",
        query.alias("query"),
        interval_minutes(F.col("interval")).cast("int").alias("interval"),
    )


def load_tests(classified: DataFrame) -> DataFrame:
    """``(table_name, text)`` of each table's data tests."""
    return preferred_text(classified, "test")


def load_ddl(classified: DataFrame) -> DataFrame:
    """``(table_name, text)`` of each processor's declared output, in lower case."""
    return preferred_text(classified, "ddl").withColumn("text", F.lower("text"))


def load_settings(classified: DataFrame) -> DataFrame:
    """``(scope, level, key, value)`` rows from the settings files.

    The scope is empty for the whole folder, a schema, or a table name.  Of a key that
    a file sets twice, the last line counts.
    """
    path = F.regexp_replace("path", r"\.conf\z", "")
    name = F.regexp_extract(path, r"[^/]*\z", 0)
    folder = F.regexp_extract(path, r"\A(.*)/", 1)
    inside = folder != ""
    dotted = F.contains(name, F.lit("."))
    level = (
        F.when(~inside & (name == GLOBAL_SETTINGS), GLOBAL)
        .when(~inside & dotted, TABLE_OUTSIDE)
        .when(~inside, SCHEMA_OUTSIDE)
        .when(folder == name, SCHEMA_INSIDE)
        .otherwise(TABLE_INSIDE)
    )
    scope = (
        F.when(level == GLOBAL, "")
        .when((level == TABLE_INSIDE) & ~dotted, F.concat(folder, F.lit("."), name))
        .otherwise(name)
    )
    line = F.posexplode(F.split("text", "\n")).alias("place_in_file", "line")
    pair = r"\A\s*([^#;=\s][^=]*?)\s*=\s*(.*?)\s*\z"
    return (
        classified.where("kind = 'settings'")
        .select("path", scope.alias("scope"), level.alias("level"), line)
        .where(F.rlike("line", F.lit(pair)))
        .groupBy("path", "scope", "level", F.lower(F.regexp_extract("line", pair, 1)).alias("key"))
        .agg(F.max_by(F.regexp_extract("line", pair, 2), "place_in_file").alias("value"))
        .select("scope", "level", "key", "value")
    )


def find_definitions(definitions: DataFrame, names: DataFrame) -> DataFrame:
    """The definitions asked for by ``names(table_name)``; ``found`` is false for unknown names."""
    known = definitions.withColumn("found", F.lit(True))
    return names.join(known, "table_name", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def find_definition(definitions: DataFrame, name: str):
    """One definition as a row; an unknown name is an error."""
    rows = definitions.where(F.col("table_name") == name).take(1)
    if not rows:
        raise LookupError(f"no definition for {name}")
    return rows[0]


def decode_config(config: Column) -> Column:
    return F.from_json(config, "map<string,string>")


def encode_config(config: Column) -> Column:
    """JSON text with keys in order, so equal settings give equal text; empty gives NULL."""
    in_order = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.when(F.size(config) > 0, F.to_json(in_order, {"ignoreNullFields": "false"}))


# Names of text types in declared schemas that Spark calls STRING.
_TEXT_TYPE = r"\b(?:text|character varying|varchar|bpchar|nvarchar)(?:\s*\(\s*(?:\d+|max)\s*\))?"


def declared_schema(ddl: str) -> StructType:
    """The columns of a ``create table name(...)`` statement as a Spark schema.

    Column encodings and text types of other warehouses are translated.
    """
    columns = re.search(
        r"create\s+table\s+[\w.\"]+\s*\((.*?)\)\s*(?:;|\Z|dist|sort|compound|interleaved|backup)",
        ddl.lower(),
        re.DOTALL,
    )
    if columns is None:
        raise ValueError("no column list in the declared schema")
    body = re.sub(r"\s+encode\s+\w+", "", columns.group(1))
    body = re.sub(_TEXT_TYPE, "string", body)
    return StructType.fromDDL(body.replace('"', "`"))
