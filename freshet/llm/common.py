"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.session import stage

# White space and words of the contracts.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, whatever filters or columns build on it.

    A one-element ``explode`` keeps the optimizer from copying ``value`` into each use.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def like(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of ``df`` with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


class Running(NamedTuple):
    rows: DataFrame
    total: int


def running_sum(rows: DataFrame, key: str, value: str, out: str, n_rows: int, block_rows: int = 50_000) -> Running:
    """For each row the sum of ``value`` over all rows before it, in an order fixed by ``key``.

    ``key`` is unique.  Rows are dealt by a hash of it into blocks of about
    ``block_rows``; sums inside a block and sums of whole blocks are added, so no
    task sees more than a block of rows or the list of blocks.
    """
    from pyspark.sql import Window

    n_blocks = max(1, math.ceil(n_rows / block_rows))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums, _ = stage(sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums.select("_block", "_base"), "_block")
        .withColumn(out, F.col(out) + F.col("_base"))
    )
    return Running(summed.drop("_block", "_base"), total)


def byte_slices(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut a string column into runs ``(first, rows)`` of about ``limit`` bytes, a row at least.

    Keeps what a task builds from a batch small even where many texts are long.
    """
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end - at
        at = end


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have fewer rows than Spark's default: here rows are whole documents.

    A number that the user has set is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
