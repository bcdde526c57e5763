"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are built-in functions over whole texts.  Trees are fitted on a bounded
sample of labelled rows, then flattened into arrays that a task walks for a whole batch
of rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import fresh, remainder_of
from freshet.llm.stats import SHARES, labelled_sample, with_stats

SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth; node ``i`` has the children ``2i+1`` and ``2i+2``.

    ``feature`` and ``threshold`` have a row per tree and a column per inner node,
    ``leaf`` a column per leaf.  Rows above the threshold go right; a node without a
    split has an infinite threshold, so its rows go left.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-raw))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 60,
    depth: int = 4,
    n_bins: int = 64,
    rate: float = 0.2,
    smoothing: float = 1.0,
    least_weight: float = 1.0,
) -> Trees:
    """Boost ``n_trees`` trees on the logistic loss, splitting on histograms of ``n_bins`` bins.

    Without rows every score is 0.5; with one label only it is that label's smoothed share.
    """
    n, n_features = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((n_trees, inner), dtype=np.int64)
    threshold = np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, leaves))
    if not n:
        return Trees(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(n_features)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    for tree in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for f, cut in enumerate(cuts):
                cell = at * n_bins + bins[:, f]
                g = np.bincount(cell, gradient, width * n_bins).reshape(width, n_bins)
                h = np.bincount(cell, weight, width * n_bins).reshape(width, n_bins)
                gl, hl = g.cumsum(1)[:, : len(cut)], h.cumsum(1)[:, : len(cut)]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + smoothing) + (gt - gl) ** 2 / (ht - hl + smoothing) - gt**2 / (ht + smoothing)
                gain[(hl < least_weight) | (ht - hl < least_weight)] = 0
                where = gain.argmax(1)
                top = gain[np.arange(width), where]
                better = top > best
                best[better] = top[better]
                feature[tree, first : first + width][better] = f
                threshold[tree, first : first + width][better] = cut[where[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[tree, node]] > threshold[tree, node])
        at = node - inner
        leaf[tree] = rate * np.bincount(at, gradient, leaves) / (np.bincount(at, weight, leaves) + smoothing)
        raw += leaf[tree, at]
    return Trees(base, feature, threshold, leaf)


def fit_quality(
    docs: DataFrame, labels: DataFrame, where: Column | None = None, sample_rows: int = SAMPLE_ROWS, **params: float
) -> Trees:
    """Fit on the statistics of at most ``sample_rows`` labelled documents, picked by a hash of the id.

    ``where`` is a condition on ``_id``.  Only the sample's statistics reach the driver.
    """
    sample = with_stats(labelled_sample(docs, labels, "quality", sample_rows, where), "s")
    rows = sample.select("_id", *(F.col("s")[f].cast("double").alias(f) for f in SHARES), "_y").toPandas()
    rows = rows.sort_values(["_id", *SHARES], kind="stable")
    return fit_trees(rows[list(SHARES)].to_numpy(float), rows["_y"].to_numpy(float), **params)


def score(docs: DataFrame, trees: Trees, out: str) -> DataFrame:
    """Add double ``out``, the probability of label 1; empty and null texts get one too.

    Rows are scored one by one: repeated rows score alike, other columns stay as they are.
    """
    stats = fresh(docs, "_stats")

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.scores(np.column_stack([c.to_numpy(float) for c in columns])))

    features = [F.col(stats)[f].cast("double") for f in SHARES]
    return with_stats(docs, stats).withColumn(out, scored(*features)).drop(stats)


def quality_classifier(
    docs: DataFrame, labels: DataFrame, least: float = 0.5, learn_from: DataFrame | None = None
) -> DataFrame:
    """The documents that score at least ``least``; columns unchanged.

    Learns from the labelled documents of ``learn_from`` (``docs``, if not given) whose
    crc32(doc_id) modulo 3 is not 1.  Where ``docs`` have been filtered by quality before,
    give the unfiltered ones: what is left has one label, from which nothing can be learned.
    """
    source = docs if learn_from is None else learn_from
    trees = fit_quality(source, labels, remainder_of(F.col("_id"), 3) != 1)
    name = fresh(docs, "_score")
    scored = score(docs, trees, name)
    return scored.where(F.col(name) >= least).select(*docs.columns)
