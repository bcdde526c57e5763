"""URL filters: host and path rules as intervals of reversed-host keys, met in a sorted sweep.

The key of a host is its labels from last to first, a dot after each: ``www.example.com``
becomes ``com.example.www.``.  All subdomains of a host, and no other host, lie between
its key and the same key with the last dot raised to ``/``, so a rule is an interval and
nested rules are nested intervals.  URLs and interval ends are sorted together; each URL
sees the stack of rules that are open at its place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.common import lower_ascii, partitions


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, whole, 1)), F.regexp_extract(text, whole, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _after(key: Column) -> Column:
    """The least key above all keys that start with ``key``; ``/`` follows the dot."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def rule_events(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """The sweep's events: a key and the stack of rules open from there on.

    A host's stack holds its own rules and those of the hosts it belongs to, found by an
    equality join on its suffixes.  Where its interval ends, the stack of the nearest
    enclosing host returns.
    """
    schema = "host string, path string, verdict string"
    given = spark.createDataFrame(rules, schema).distinct()
    hosts = given.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    open_rule = F.struct(
        F.length(F.concat("rule.host", "rule.path")).alias("size"),
        F.length("rule.host").alias("host_size"),
        F.col("rule.path").alias("path"),
        F.concat("rule.host", "rule.path").alias("rule"),
        F.col("rule.verdict").alias("verdict"),
    )
    reached = (
        hosts.select("host", F.explode(suffixes).alias("of"))
        .join(given.select(F.struct("host", "path", "verdict").alias("rule"), F.col("host").alias("of")), "of")
        .select("host", "of", open_rule.alias("open"))
    )
    starts = reached.groupBy("host").agg(F.collect_list("open").alias("stack"))
    outer = reached.where(F.col("of") != F.col("host"))
    ends = hosts.join(outer.groupBy("host").agg(F.collect_list("open").alias("stack")), "host", "left")
    key = host_key(F.col("host"))
    return starts.select(key.alias("key"), F.lit(1).alias("kind"), "stack").unionByName(
        # Ends come before starts at the same key.
        ends.select(_after(key).alias("key"), F.lit(0).alias("kind"), F.coalesce("stack", F.array()).alias("stack"))
    )


def filter_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add struct ``judged``: ``host``, ``path``, ``rule`` and ``verdict`` of each URL.

    Of the rules that fit, the longest wins (host and path together, then the host); of
    rules given twice with two verdicts, ``block``.  Where none fits, ``rule`` is null and
    the verdict is ``default``; so it is for null, empty and other texts without a host.
    Repeated rows are judged alike; a column named ``judged`` is replaced.

    Rows are dealt evenly into blocks, whatever their hosts; each block sweeps its own
    rows against all rule events, of which there are two per rule host.
    """
    spark = pages.sparkSession
    n_blocks = 4 * partitions(spark)
    rest = pages.drop("judged")
    row = F.struct(*rest.columns)
    host, path = host_and_path(F.col(url))
    urls = rest.select(row.alias("row"), host.alias("host"), path.alias("path")).select(
        # Even blocks for a hot host: every column of the row takes part in the deal.
        F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"),
        host_key(F.col("host")).alias("key"),
        F.lit(2).alias("kind"),
        "row",
        "host",
        "path",
    )
    events = rule_events(spark, rules).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "key", "kind", "stack"
    )
    sweep = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        urls.unionByName(events, allowMissingColumns=True)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 2")
    )
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(
        F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["verdict"], r["rule"], r["path"]))
    )
    met = met.withColumn("best", best)
    return met.select(
        "row.*",
        F.struct(
            "host",
            "path",
            F.col("best")["rule"].alias("rule"),
            F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"),
        ).alias("judged"),
    )
