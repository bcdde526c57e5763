"""Data tests: boolean selects that must hold before a candidate goes live."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from freshet.functions.text import retarget


class DataTestsFailed(Exception):
    """Some data tests of a candidate did not hold."""

    def __init__(self, table: str, failed: list[str]):
        super().__init__(f"data tests failed for {table}: {', '.join(failed)}")
        self.table, self.failed = table, failed


# What a semicolon ends nothing in: literals, quoted names, comments.
_QUIET = r"""'(?:[^'\\]|\\.|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""


def split_statements(text: str) -> list[str]:
    """The statements of a text, cut at semicolons outside literals, names and comments."""
    parts = re.findall(rf"(?:{_QUIET}|[^;])+", text, re.DOTALL)
    return [part for part in parts if part.strip()]


def run_tests(spark: SparkSession, text: str) -> DataFrame:
    """``(test_name, passed)`` per statement: the first column of its first row.

    A NULL or a missing row is a failed test.  All statements run as one job.
    """

    def verdict(statement: str) -> DataFrame:
        result = spark.sql(statement)
        name = result.columns[0]
        value = F.first(F.col(f"`{name}`").cast("boolean"))
        return result.limit(1).agg(F.coalesce(value, F.lit(False)).alias("passed")).select(
            F.lit(name).alias("test_name"), "passed"
        )

    verdicts = [verdict(statement) for statement in split_statements(text)]
    if not verdicts:
        return spark.createDataFrame([], "test_name string, passed boolean")
    return reduce(DataFrame.unionAll, verdicts)


class Observed(NamedTuple):
    """Tests that a write answers on its way, by name, and the text of those that need statements."""

    metrics: dict[str, Column]
    statements: dict[str, str]
    rest: str

    def over(self, table: str, candidate: str) -> Observed:
        """The same tests, their statements about the candidate."""
        moved = {name: retarget(text, table, candidate) for name, text in self.statements.items()}
        return Observed(self.metrics, moved, retarget(self.rest, table, candidate))


# One aggregate over a whole table and nothing else; what it may be made of is left to Spark.
_WHOLE_TABLE = r"\s*select\s+(?P<value>(?:(?!\bfrom\b).)+?)\s+as\s+(?P<name>\w+)\s+from\s+(?P<table>[\w.`\"]+)\s*"


def observable(df: DataFrame, text: str, table: str) -> Observed:
    """Split data tests on ``table`` into metrics of writing ``df`` to it and statements to be run afterwards.

    A test becomes a metric if it is one named value over all rows of the table and Spark takes it
    as a metric of ``df``: aggregates that are neither distinct nor nested.  All others stay
    statements, word for word, among them each whose name another test has too.
    """
    metrics, statements, rest = {}, {}, []
    parts = split_statements(text)
    found = [re.fullmatch(_WHOLE_TABLE, part, re.DOTALL | re.IGNORECASE) for part in parts]
    names = [m["name"].lower() for m in found if m]
    for part, match in zip(parts, found):
        metric = None
        if match and re.sub(r'[`"]', "", match["table"]).lower() == table.lower() and names.count(match["name"].lower()) == 1:
            metric = _metric(df, match["value"], match["name"])
        if metric is None:
            rest.append(part)
        else:
            metrics[match["name"]], statements[match["name"]] = metric, part
    return Observed(metrics, statements, ";".join(rest))


def _metric(df: DataFrame, value: str, name: str) -> Column | None:
    """The value as a boolean metric of ``df``; None if Spark does not take it as one."""
    try:
        metric = F.expr(value).cast("boolean").alias(name)
        # Is analysed at once: a query over ``df`` and, unlike one, without distinct or plain columns.
        df.observe(Observation(), F.count(F.lit(1)).alias("_rows"), metric).schema  # noqa: B018
        return metric
    except (AnalysisException, ParseException):
        return None


def observed_verdicts(spark: SparkSession, tests: Observed, seen: dict) -> DataFrame:
    """``(test_name, passed)`` from the metrics of a write and from the statements that are left.

    A write that had no rows to read may tell nothing; its tests are then run as statements.
    """
    told = [(name, bool(seen[name])) for name in tests.metrics if name in seen]
    missing = [tests.statements[name] for name in tests.metrics if name not in seen]
    verdicts = run_tests(spark, ";".join([*missing, tests.rest]))
    return verdicts.unionAll(spark.createDataFrame(told, "test_name string, passed boolean")) if told else verdicts


def row_expectations(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``(test_name, passed, failed_rows)`` for conditions on every row, in one pass."""
    misses = df.agg(
        *[
            F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0))
            .cast("bigint")
            .alias(name)
            for name, c in conditions.items()
        ]
    )
    return misses.unpivot([], list(conditions), "test_name", "failed_rows").select(
        "test_name", (F.col("failed_rows") == 0).alias("passed"), "failed_rows"
    )


def verdict(results: DataFrame) -> tuple[bool, list[str]]:
    """Whether all tests hold, and the names of those that do not; one name per statement."""
    failed = [r.test_name for r in results.where("NOT coalesce(passed, false)").toLocalIterator()]
    return not failed, failed
