"""Python between a definition's select and its table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from freshet.operators.publish import select_rows

Processor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def process(df: DataFrame, processor: Processor, schema: StructType | str) -> DataFrame:
    """Run a function over batches of rows; the output columns are declared, never guessed.

    The function sees an iterator of batches of one partition.  What needs more
    than a batch at a time (totals, ranks) belongs in the select.
    """
    return df.mapInPandas(processor, schema)


def process_query(
    spark: SparkSession, query: str, processor: Processor, schema: StructType | str
) -> DataFrame:
    return process(select_rows(spark, query), processor, schema)
