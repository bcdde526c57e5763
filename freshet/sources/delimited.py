"""Delimited files: header, ``;`` between fields, blanks read back as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Fixed values of the file format.
FORMAT = {
    "sep": ";",
    "header": "true",
    "escape": "\\",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A field may hold line ends, so a file is read by one task; this bounds the file.
ROWS_PER_FILE = 100_000


def write_delimited(df: DataFrame, path: str) -> None:
    """Write one folder of files with a header each; an empty input gives headers only."""
    (
        df.write.mode("overwrite")
        .options(**FORMAT, maxRecordsPerFile=ROWS_PER_FILE)
        .csv(path, nullValue="", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def read_delimited(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read with a declared schema; empty and blank text fields become NULL."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.options(**FORMAT, multiLine=True).csv(
        path, schema=schema, mode="FAILFAST", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )
    return raw.select(
        *[
            F.when(F.trim(f.name) != "", F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )
