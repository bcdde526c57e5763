"""Quality rules: a decision list learned from labelled statistics, as Spark conditions.

Rules are grown literal by literal, pruned on rows they were not grown on, and
learned one after another on the rows that earlier rules leave (sequential
covering).  Every count comes from a Spark aggregation of at most one row per
statistic and bin.
"""

from __future__ import annotations

import functools
import math
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import fresh
from freshet.llm.stats import SHARES, labelled_sample, with_stats
from freshet.session import stage

SAMPLE_ROWS = 20_000


class Literal(NamedTuple):
    """A threshold on one statistic: ``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, stats: Column) -> Column:
        value = stats[self.feature].cast("double")
        return value > self.threshold if self.above else value <= self.threshold


Rule = list[Literal]


def rule_holds(rule: Rule, stats: Column) -> Column:
    return functools.reduce(operator.and_, (x.holds(stats) for x in rule))


def base_failed(stats: Column) -> Column:
    """Too short, or more than half of its words in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def decision(rules: list[Rule], stats: Column) -> Column:
    """The number of the first rule that rejects the row, from 1; null if none does."""
    chain = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        chain = chain.when(rule_holds(rule, stats), F.lit(number))
    return chain


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the rows to be rejected by narrowing (p0, n0) to (p, n)."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _literals(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Literal, int, int]]:
    """Every threshold literal with the rejected and kept rows that meet it."""

    def bin_of(name: str, at: list[float]) -> Column:
        value = F.col("s")[name].cast("double")
        below = F.filter(F.array(*map(F.lit, at)), lambda cut: value > cut)
        return F.struct(F.lit(name).alias("feature"), F.size(below).alias("bin"))

    bins = F.array(*(bin_of(name, at) for name, at in cuts.items()))
    counted = (
        rows.select(F.explode(bins).alias("b"), "y")
        .groupBy("b.feature", "b.bin")
        .agg(F.sum(1 - F.col("y")).alias("p"), F.sum("y").alias("n"))
        .collect()  # at most one row per statistic and bin
    )
    found = []
    for name, at in cuts.items():
        p, n = [0] * (len(at) + 1), [0] * (len(at) + 1)
        for row in counted:
            if row["feature"] == name:
                p[row["bin"]], n[row["bin"]] = row["p"], row["n"]
        for i, x in enumerate(at):
            found.append((Literal(name, True, x), sum(p[i + 1 :]), sum(n[i + 1 :])))
            found.append((Literal(name, False, x), sum(p[: i + 1]), sum(n[: i + 1])))
    return found


def _centred(literal: Literal, rows: DataFrame) -> Literal:
    """The same literal with its threshold halfway between the rows on either side of it."""
    value = F.col("s")[literal.feature].cast("double")
    below, above = rows.agg(
        F.max(F.when(value <= literal.threshold, value)), F.min(F.when(value > literal.threshold, value))
    ).first()
    return literal if below is None or above is None else literal._replace(threshold=(below + above) / 2)


def learn_rules(
    labelled: DataFrame,
    max_rules: int = 8,
    max_literals: int = 3,
    n_cuts: int = 32,
    least_precision: float = 0.97,
    least_rows: int = 5,
) -> list[Rule]:
    """Rules that reject rows with ``y`` = 0, from a stored table of ``(_id, s, y)``.

    Two thirds of the rows grow a rule, one third prunes it.  A rule is taken if it
    rejects ``least_rows`` at ``least_precision`` on the whole; learning ends with the
    first that does not.  Without both labels there is no rule.
    """
    at = F.percentile_approx
    cuts_row = labelled.agg(
        *(at(F.col("s")[f].cast("double"), [i / n_cuts for i in range(1, n_cuts)], 10_000).alias(f) for f in SHARES)
    ).first()
    # Cuts of the rows to reject too: they may be too few to show in the quantiles of all.
    bad_row = labelled.where("y = 0").agg(
        *(at(F.col("s")[f].cast("double"), [i / n_cuts for i in range(1, n_cuts)], 10_000).alias(f) for f in SHARES)
    ).first()
    cuts = {f: sorted({*(cuts_row[f] or ()), *(bad_row[f] or ())}) for f in SHARES}
    cuts = {f: x for f, x in cuts.items() if x}
    growing = F.pmod(F.xxhash64("_id"), F.lit(3)) != 0
    s, rules = F.col("s"), []
    while cuts and len(rules) < max_rules:
        open_rows = labelled.where(decision(rules, s).isNull())
        grow = open_rows.where(growing)
        p0, n0 = grow.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
        if not p0 or not n0:
            break
        rule: Rule = []
        while len(rule) < max_literals and n0:
            rows = grow.where(rule_holds(rule, s)) if rule else grow
            best, p, n = max(_literals(rows, cuts), key=lambda x: _gain(x[1], x[2], p0, n0))
            if _gain(p, n, p0, n0) <= 0:
                break
            rule.append(_centred(best, rows))
            p0, n0 = p, n
        if not rule:
            break
        lengths = range(1, len(rule) + 1)
        sums = [F.sum(F.when(rule_holds(rule[:k], s), x)) for k in lengths for x in (1 - F.col("y"), F.col("y"))]
        seen = [x or 0 for x in open_rows.where(~growing).agg(*sums).first()]
        worth = {k: (seen[2 * k - 2] - seen[2 * k - 1]) / max(1, seen[2 * k - 2] + seen[2 * k - 1]) for k in lengths}
        rule = rule[: max(lengths, key=lambda k: (worth[k], -k))]
        p, n = open_rows.where(rule_holds(rule, s)).agg(F.sum(1 - F.col("y")), F.sum("y")).first()
        if (p or 0) < least_rows or p < least_precision * (p + n):
            break
        rules.append(rule)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from the statistics of at most ``sample_rows`` labelled documents.

    Documents that the base rules reject teach nothing.
    """
    sample = with_stats(labelled_sample(docs, labels, "quality", sample_rows), "s")
    sample = sample.where(~base_failed(F.col("s"))).select("_id", "s", F.col("_y").alias("y"))
    # A few small files, without holding back the scan.
    stored, _ = stage(sample.repartition(4))
    return learn_rules(stored)


def judge(docs: DataFrame, rules: list[Rule], out: str) -> DataFrame:
    """Add struct ``out`` to each document: its statistics, ``base_failed``, ``rule``, ``kept``.

    Null and empty texts have no words and fail the base rules.  Each row is judged on
    its own: repeated rows get the same verdict, and other columns stay as they are.
    """
    judged = with_stats(docs, out)
    s = F.col(out)
    failed, rule = base_failed(s), decision(rules, s)
    return judged.withColumn(
        out,
        F.struct(
            *(s[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & rule.isNull()).alias("kept"),
        ),
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rules and the learned rules keep; columns unchanged."""
    name = fresh(docs, "_verdict")
    judged = judge(docs, fit_rules(docs, labels), name)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)
