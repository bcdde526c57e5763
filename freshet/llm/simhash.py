"""SimHash near-duplicates: fingerprints, links by bit-sliced comparison, components.

Equal fingerprints are collapsed first.  Two fingerprints that differ in at most two bits
agree in two of four 16-bit blocks, and of the other 32 bits in one of three parts; so
each pair that must be linked meets under one of 18 keys of 42 or 43 bits.  At most 2^22
fingerprints can share a key, 32 MB: no group grows beyond that.  Inside a group, bit
planes are stored one below the other and many distances are counted at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import fresh, modest_batches
from freshet.session import stage

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))
# Positions that are compared before looking whether all are out of reach.
BLOCK_POSITIONS = 1 << 16


# Fingerprints ---------------------------------------------------------------------


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, bit 0 first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text in UTF-8, as a signed 64-bit integer; 0 without words."""
    words = text.lower().split()  # both act on ASCII letters and white space only
    if len(words) < shingle:
        pieces = [b" ".join(words)] if words else []
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in pieces], np.uint64)
    if not len(hashes):
        return 0
    bits = (2 * _bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, out: str, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Add long ``out``; a null text is empty and has the fingerprint 0."""

    modest_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint((x or "").encode(), shingle) for x in texts], dtype="int64")

    return docs.withColumn(out, made(F.col(text).cast("string")))


# Links ----------------------------------------------------------------------------


def _keys(fp: Column) -> Column:
    """The 18 keys of a fingerprint, each with its number in the top bits."""
    keys = []

    def bits(at: int, n: int) -> Column:
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    for pair in combinations(range(4), 2):
        (a, n), (b, m) = (BLOCKS[i] for i in pair)
        (c, _), (d, _) = (BLOCKS[i] for i in range(4) if i not in pair)
        # The other 32 bits as one number, in parts of 11, 11 and 10 bits.
        rest = bits(c, 16).bitwiseOR(F.shiftleft(bits(d, 16), 16))
        for at, k in ((0, 11), (11, 11), (22, 10)):
            part = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << k) - 1).cast("long"))
            same = bits(a, n).bitwiseOR(F.shiftleft(bits(b, m), 16))
            keys.append(
                F.shiftleft(F.lit(len(keys)).cast("long"), 43).bitwiseOR(F.shiftleft(part, 32)).bitwiseOR(same)
            )
    return F.array(*keys)


def _planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row ``b`` holds bit ``b`` of each value."""
    spread = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(spread.T, axis=1)


def near(planes: np.ndarray, query: int, n: int, radius: int) -> np.ndarray:
    """Positions whose value differs from ``query`` in at most ``radius`` bits.

    A counter for each position is kept in vertical bits: adding a plane is a carry
    through a few bitwise operations for all positions at once.  A counter that passes
    ``radius`` stays out; a block is left as soon as all of its counters are out.
    """
    width = radius.bit_length()
    found = []
    step = BLOCK_POSITIONS // 8
    for at in range(0, planes.shape[1], step):
        block = planes[:, at : at + step]
        counter = [np.zeros(block.shape[1], np.uint8) for _ in range(width)]
        out = np.zeros(block.shape[1], np.uint8)
        for b in range(64):
            carry = ~block[b] if query >> b & 1 else block[b]
            for digit in range(width):
                counter[digit], carry = counter[digit] ^ carry, counter[digit] & carry
            out = out | carry
            if b % 8 == 7 and (out == 255).all():
                break
        else:
            # Counters above the radius: compare from the highest digit down.
            above, equal = np.zeros_like(out), np.full_like(out, 255)
            for digit in reversed(range(width)):
                bound = 255 if radius >> digit & 1 else 0
                above |= equal & counter[digit] & ~np.uint8(bound)
                equal &= ~(counter[digit] ^ np.uint8(bound))
            inside = np.unpackbits(~(out | above))[: max(0, n - at * 8)]
            found.append(np.flatnonzero(inside) + at * 8)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a forest that joins what is linked among ``values``: one fewer than they are, at most.

    Each value is compared with those that no link has reached yet; they grow fewer,
    and the planes are packed anew when half are gone.
    """
    values = np.unique(values)
    links: list[tuple[int, int]] = []
    open_values, alive = values, np.ones(len(values), bool)
    planes, frontier = _planes(values), []
    while alive.any():
        if not frontier:
            first = int(alive.argmax())
            alive[first] = False
            frontier = [int(open_values[first])]
        query = frontier.pop()
        hits = near(planes, query, len(open_values), radius)
        hits = hits[alive[hits]]
        alive[hits] = False
        reached = [int(x) for x in open_values[hits]]
        links += [(query, x) for x in reached]
        frontier += reached
        if 2 * alive.sum() < len(open_values) and len(open_values) > 64:
            open_values = open_values[alive]
            planes, alive = _planes(open_values), np.ones(len(open_values), bool)
    return links


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between distinct ``fp`` that join all within ``radius`` of two bits or fewer.

    Chains are enough: what a chain of links joins is one component.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the keys find distances up to 2")
    groups = (
        fingerprints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy().view(np.uint64)
            made: list[tuple[int, int]] = []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if hi - lo == 2:
                    x, y = int(values[lo]), int(values[lo + 1])
                    if (x ^ y).bit_count() <= radius:
                        made.append((x, y))
                else:
                    made += spanning_links(values[lo:hi], radius)
            pairs = np.array(made, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    found = groups.select("fps").mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# Components -----------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the component's least node.

    Two steps in turn: neighbours above a node hang under its least neighbour, then
    those below it do.  Each round is written to the shared folder; rounds grow with
    the logarithm of the size of a component.
    """
    now, n = stage(edges.where("a <> b"))
    state = None
    for _ in range(max_rounds):
        if not n:
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # ``large`` leads from greater to lesser nodes.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, n = stage(small.union(least.select("u", "m")).distinct().toDF("a", "b"))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def component_ids(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Map each distinct ``fp`` of a stored ``(fp, doc_id)`` to ``component_id``, its least id."""
    distinct, _ = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots, _ = stage(components(links(distinct, radius)))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: the least id among all it is linked to.

    Texts without words share the fingerprint 0 and are linked like any other.  Null ids
    stay in the result but name no component unless all of it is null.  Repeated rows are
    repeated; other columns are not read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows, _ = stage(with_fingerprint(ids, "fp", shingle).select("doc_id", "fp"))
    return rows.join(component_ids(rows, radius), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of its least id, of equal ids the first stored; columns unchanged."""
    fp, uid, row = (fresh(docs, x) for x in ("_fp", "_uid", "_row"))
    marked = with_fingerprint(docs, fp, shingle).withColumn(uid, F.monotonically_increasing_id())
    stored, _ = stage(marked)
    rows = stored.select(F.col(fp).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), F.col(uid).alias("uid"))
    classes = component_ids(rows, radius)
    # Collapse copies before they meet their component; null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    kept = (
        rows.groupBy("fp").agg(first.alias("best"))
        .join(classes, "fp")
        .groupBy("root")
        .agg(F.min("best").alias("best"))
        .select(F.col("best.uid").alias(row))
    )
    return stored.join(kept, F.col(uid) == F.col(row), "left_semi").select(*docs.columns)
