"""Take in only what has changed in a definition folder.

A manifest ``(path, length, modified)`` says what the last scan has seen.  A listing reads no
file; only new and changed files are opened.  An empty file counts as not there.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import stage_sized as stage
from freshet.sources.definitions import FILES_PER_TASK, list_files, read_files

MANIFEST_SCHEMA = "path string, length bigint, modified timestamp"

# About as many changed files as a task opens by their paths.
NAMED_PATHS = FILES_PER_TASK


class Changes(NamedTuple):
    """``files(path, text, known)`` that are new or changed, ``gone(path)``, and the next manifest."""

    files: DataFrame
    gone: DataFrame
    manifest: DataFrame
    n_changed: int
    n_gone: int


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST_SCHEMA)


def scan_changes(spark: SparkSession, root: str, manifest: DataFrame, named_paths: int = NAMED_PATHS) -> Changes:
    """What differs from ``manifest``; a file counts as changed if its length or time of change differs.

    Nothing is stored: keep ``manifest`` of the result once its files have been taken in, so a
    scan that is broken off is done again.
    """
    listed, _ = list_files(spark, root)
    known = manifest.select("path", F.lit(True).alias("known"))
    differing = listed.join(manifest, ["path", "length", "modified"], "left_anti").join(known, "path", "left")
    differing, n_changed = stage(differing.select("path", F.coalesce("known", F.lit(False)).alias("known")))
    gone, n_gone = stage(manifest.join(listed, "path", "left_anti").select("path"))
    texts = read_files(spark, root, differing, n_changed, named_paths)
    # Read now: the folder may go on changing.
    files, _ = stage(texts.join(differing, "path"))
    return Changes(files, gone, listed, n_changed, n_gone)


def take_changes(files: DataFrame, changes: Changes) -> DataFrame:
    """The stored ``files(path, text)`` after a scan, without opening unchanged ones."""
    touched = changes.files.select("path").unionByName(changes.gone)
    return files.join(touched, "path", "left_anti").unionByName(changes.files.select("path", "text"))
