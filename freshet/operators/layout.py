"""Physical layout of a table: bucket key, sort key, distribution style."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

REPLICATE_MAX_BYTES = 64 * 1024 * 1024


class Layout(NamedTuple):
    distkey: str | None = None
    sortkey: str | None = None
    diststyle: str | None = None

    @classmethod
    def from_config(cls, config: dict | None) -> Layout:
        config = config or {}
        return cls(*(config.get(field) or None for field in cls._fields))


Observe = Callable[[DataFrame], DataFrame]


def unobserved(df: DataFrame) -> DataFrame:
    return df


def _hashable(kind: DataType) -> bool:
    return not isinstance(kind, MapType | VariantType) and "map<" not in kind.simpleString()


def laid_out(df: DataFrame, layout: Layout, observe: Observe = unobserved) -> DataFrameWriter:
    """A writer for ``df`` in the given layout.

    A distribution key becomes buckets: later joins and groupings on it need no
    shuffle.  There are as many buckets as shuffle partitions, so the rebalance
    brings each bucket to one task, and to several where a hot key makes it large.
    A sort key orders rows, so file statistics can skip blocks; ties are parted by
    a hash of the row.

    ``observe`` adds metrics to the rows as they are written, behind every shuffle: only
    tasks of the last stage count once, whatever executors are lost.
    """
    if layout.distkey:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer = observe(df.hint("rebalance", layout.distkey)).write.bucketBy(buckets, layout.distkey)
        return writer.sortBy(layout.sortkey) if layout.sortkey else writer
    if layout.sortkey:
        columns = [f.name for f in df.schema.fields if _hashable(f.dataType)]
        ties = F.xxhash64(*columns) if columns else F.lit(0)
        ranges = df.repartitionByRange(F.col(layout.sortkey), ties)
        return observe(ranges.sortWithinPartitions(layout.sortkey)).write
    if (layout.diststyle or "").lower() == "even":
        return observe(df.hint("rebalance")).write
    return observe(df).write


def table_bytes(spark: SparkSession, name: str) -> int | None:
    """The stored size of a table, measured now."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    described = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
    return (described.get("statistics") or {}).get("size_in_bytes")


def read_table(spark: SparkSession, name: str, layout: Layout = Layout()) -> DataFrame:
    """Read a table; one kept on every node is broadcast, if its size allows it."""
    df = spark.table(name)
    if (layout.diststyle or "").lower() == "all":
        size = table_bytes(spark, name)
        if size is not None and size <= REPLICATE_MAX_BYTES:
            return F.broadcast(df)
    return df
