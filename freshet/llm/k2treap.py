"""Ranked lexical search over a grid of terms and documents kept as K2-treaps.

Documents are dealt into blocks where they lie, without a shuffle.  A block has a grid: a row
per term (frequent ones first), a column per document (short ones first), a cell per posting
with the impact of the term in that document.  The grid is a quadtree without its empty cells;
a node holds a four-bit mask of its children, which lie side by side on the next level, and the
greatest impact beneath it.

A query takes the path of each of its rows down to the level where a cell spans all columns.
From there ranges of documents are split in halves, all paths of the query at once, and the
ranges with the best sums of weighted maxima go first.  A range whose sum is below the least
of the results so far is left out; these come along from block to block of a task.  At a
single document the sum is its score, so results are exact.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import byte_slices, lower_ascii, modest_batches, running_sum, text_of
from freshet.operators.graph import union_all
from freshet.session import shared_dir, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# What a block and a broadcast set of queries hold at most, beyond one text or one query.
BLOCK_BYTES, BLOCK_DOCS, GROUP_ENTRIES = 3_000_000, 1024, 200_000
# Ranges that are split in one step.
STEP = 128
PARTS = 256

_IDS = pa.list_(pa.int64())
_BLOCK = pa.schema(
    [("doc_ids", _IDS), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("masks", pa.list_(pa.binary())), ("maxima", pa.list_(pa.binary()))]
)
_BLOCK_DDL = "doc_ids array<long>, terms array<string>, dfs array<int>, masks array<binary>, maxima array<binary>"
_POP = np.array([i.bit_count() for i in range(16)], np.int32)


@functools.cache
def _separators() -> bytes:
    """A table that lower-cases A-Z and turns all ASCII characters outside terms into blanks."""
    return bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)).lower()


class Index(NamedTuple):
    """Blocks as a stored table, the number of documents with a term, and of all terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Each bit of a number below 2^31 moved to twice its place."""
    x = x.astype(np.uint64)
    # Masks for spreading bits by halves.
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def grow(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, depth: int) -> tuple[list[bytes], list[bytes]]:
    """The levels of a quadtree of side 2^depth, top first: masks of all but the last, maxima of all."""
    codes = 2 * spread_bits(rows) + spread_bits(columns)
    order = np.argsort(codes, kind="stable")
    codes, top = codes[order], impacts[order].astype(np.int32)
    masks, maxima = [], [top.tobytes()]
    for _ in range(depth):
        above = codes >> 2
        starts = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        masks.append(np.bitwise_or.reduceat((1 << (codes & 3)).astype(np.uint8), starts).tobytes())
        codes, top = above[starts], np.maximum.reduceat(top, starts)
        maxima.append(top.tobytes())
    return masks[::-1], maxima[::-1]


def depth_of(n: int) -> int:
    return max(0, n - 1).bit_length()


def _plain(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts as bytes, lower-cased and all but terms blank, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(_separators())
    return data, np.ascontiguousarray(offsets - offsets[0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the texts with a term, and all terms."""
    with_terms = terms = 0
    for batch in batches:
        texts = batch.column("text")
        for at, n in byte_slices(texts, BLOCK_BYTES):
            data, offsets = _plain(texts.slice(at, n))
            inside = np.frombuffer(data, np.uint8) != 32
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            # A text begins anew whatever the one before it ends with.
            first = offsets[:-1][offsets[1:] > offsets[:-1]]
            starts[first] = inside[first]
            before = np.concatenate(([0], np.cumsum(starts)))
            lengths = before[offsets[1:]] - before[offsets[:-1]]
            with_terms += int((lengths > 0).sum())
            terms += int(lengths.sum())
    yield pa.RecordBatch.from_arrays([pa.array([with_terms]), pa.array([terms])], names=["docs", "terms"])


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for at, n in byte_slices(texts, BLOCK_BYTES):
            for first in range(at, at + n, BLOCK_DOCS):
                part = batch.slice(first, min(BLOCK_DOCS, at + n - first))
                yield from _block(part.column("id"), part.column("text"), n_docs, n_terms)
                # What one block needed is given back before the next.
                pa.default_memory_pool().release_unused()


def _block(ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """One block over texts that are not null."""
    data, offsets = _plain(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    words, docs = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    words, docs = words.filter(real).dictionary_encode(), docs.filter(real).to_numpy().astype(np.int64)
    if not len(words):
        return
    lengths = np.bincount(docs, minlength=len(texts))
    columns = np.argsort(lengths, kind="stable")
    columns = columns[lengths[columns] > 0]
    place = np.zeros(len(texts), np.int64)
    place[columns] = np.arange(len(columns))
    n_words = len(words.dictionary)
    cells, tf = np.unique(docs * n_words + words.indices.to_numpy(), return_counts=True)
    docs, terms = cells // n_words, cells % n_words
    dfs = np.bincount(terms, minlength=n_words)
    by_df = np.argsort(-dfs, kind="stable")
    row = np.empty(n_words, np.int64)
    row[by_df] = np.arange(n_words)
    # Whole numbers of any size here; only the quotient has to fit.
    m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
    masks, maxima = grow(row[terms], place[docs], impacts, depth_of(max(n_words, len(columns))))
    made = [ids.take(pa.array(columns)).to_pylist(), words.dictionary.take(pa.array(by_df)).to_pylist(), dfs[by_df].tolist(), masks, maxima]
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, _BLOCK.types, strict=True)], schema=_BLOCK)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index all terms of all documents.  A null text has no terms; other columns play no part."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text"))
    modest_batches(docs.sparkSession)
    counted = texts.select("text").mapInArrow(_count, "docs long, terms long")
    n_docs, n_terms = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    path = f"{shared_dir(docs.sparkSession)}/k2treap-{uuid.uuid4().hex}"
    blocks = texts.mapInArrow(functools.partial(_blocks, n_docs=n_docs, n_terms=n_terms), _BLOCK_DDL)
    # A row is a block of some MB, so few go into a row group.
    blocks.write.option("parquet.block.row.count.limit", 8).parquet(path)
    return Index(docs.sparkSession.read.schema(_BLOCK_DDL).parquet(path), n_docs, n_terms)


class Grid:
    """A block ready for descents.  A cell is its place on its level; one past the last is no cell."""

    def __init__(self, masks: list[bytes], maxima: list[bytes], n_columns: int):
        self.depth = len(masks)
        self.top = self.depth - depth_of(n_columns)
        # Kept as narrow as they are stored: a block has some million cells.
        self.masks = [np.frombuffer(m + b"\0", np.uint8) for m in masks]
        self.first = [np.cumsum(_POP[m], dtype=np.int32) - _POP[m] for m in self.masks]
        self.maxima = [np.frombuffer(m + bytes(4), np.int32) for m in maxima]

    def child(self, level: int, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.masks[level][cells].astype(np.int64)
        below = self.first[level][cells] + _POP[mask & ((1 << quarter) - 1)]
        return np.where(mask >> quarter & 1, below, len(self.maxima[level + 1]) - 1)

    def tops(self, rows: np.ndarray) -> np.ndarray:
        """For each row its cell on the level where a cell spans all columns."""
        cells = np.zeros(len(rows), np.int64)
        for level in range(self.top):
            cells = self.child(level, cells, (rows >> (self.depth - 1 - level) & 1) * 2)
        return cells

    def best(self, rows: np.ndarray, cells: np.ndarray, weights: np.ndarray, best: Best, doc_ids: np.ma.MaskedArray) -> None:
        """Take the block's documents into ``best``, the ranges with the greatest sums first."""
        bound = int(self.maxima[self.top][cells] @ weights)
        waiting = {self.top: (np.array([bound]), np.array([0]), cells[None, :])}
        while waiting:
            level = max(waiting, key=lambda x: (waiting[x][0].max(), x))
            bounds, columns, paths = waiting.pop(level)
            hopeful = bounds >= best.least
            if not hopeful[np.argmax(bounds)]:
                return
            if level == self.depth:
                best.add(bounds, doc_ids[columns])
                continue
            chosen = np.flatnonzero(hopeful)
            if len(chosen) > STEP:
                order = np.argpartition(-bounds[chosen], STEP - 1)
                later, chosen = chosen[order[STEP:]], chosen[order[:STEP]]
                waiting[level] = bounds[later], columns[later], paths[later]
            half = (rows >> (self.depth - 1 - level) & 1) * 2
            for bit in (0, 1):
                below = self.child(level, paths[chosen], half + bit)
                sums = self.maxima[level + 1][below] @ weights
                keep = np.flatnonzero((sums > 0) & (sums >= best.least))
                if not len(keep):
                    continue
                made = sums[keep], 2 * columns[chosen[keep]] + bit, below[keep]
                if level + 1 in waiting:
                    made = tuple(np.concatenate(x) for x in zip(waiting[level + 1], made, strict=True))
                waiting[level + 1] = made


class Best:
    """The k best documents so far, equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.empty(0, np.int64), np.ma.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ma.MaskedArray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.ma.concatenate((self.ids, ids))
        order = np.lexsort((ids.data, np.ma.getmaskarray(ids), -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Queries(NamedTuple):
    """A bounded set of queries: distinct terms, and per query its terms as places there, and weights."""

    terms: list[str]
    uids: list[int]
    places: list[np.ndarray]
    weights: list[np.ndarray]


def _search(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    asked: Queries = queries.value
    vocabulary, best = pa.array(asked.terms, pa.string()), [Best(k) for _ in asked.uids]
    for batch in batches:
        for i in range(batch.num_rows):
            block = {name: batch.column(name)[i] for name in batch.schema.names}
            found = pc.index_in(vocabulary, value_set=block["terms"].values)
            rows = found.fill_null(-1).to_numpy().astype(np.int64)
            ids = block["doc_ids"].values
            ids = np.ma.MaskedArray(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
            grid = Grid(block["masks"].as_py(), block["maxima"].as_py(), len(ids))
            cells = grid.tops(np.maximum(rows, 0))
            for one, places, weights in zip(best, asked.places, asked.weights, strict=True):
                here = rows[places] >= 0
                if here.any():
                    inside = places[here]
                    grid.best(rows[inside], cells[inside], weights[here], one, ids)
    for uid, one in zip(asked.uids, best, strict=True):
        if len(one.ids):
            uids = pa.array([uid] * len(one.ids), pa.int64())
            yield pa.RecordBatch.from_arrays([uids, pa.array(one.ids.tolist(), pa.int64()), pa.array(one.scores)], names=["uid", "doc_id", "score"])


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.ln((2 * F.lit(float(n_docs)) + 2) / (2 * df.cast("double") + 1))).cast("long")


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 per item.

    Equal scores go by ascending id, null ids last; documents that repeat an id are told apart by
    nothing.  Every row of ``items`` is an item, also if it repeats; one without known terms has
    no rows.  Items go to the tasks in sets of a bounded number of terms, one pass over the
    blocks for each set, so their number has no limit.
    """
    spark = items.sparkSession
    named, n_items = stage(
        items.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(item_id).alias("item"),
            F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(TERM), F.lit(0)).alias("terms"),
        )
    )
    entries = named.select("uid", F.explode("terms").alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("times"))
    listed = index.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select("e.terms", "e.dfs")
    wanted = entries.select("term").distinct()
    dfs = listed.join(wanted, F.col("terms") == F.col("term"), "left_semi").groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    weighted = entries.join(dfs, "term").select("uid", "term", (weight(F.col("df"), index.n_docs) * F.col("times")).alias("weight"))
    weighted, n_entries = stage(weighted)
    sizes = weighted.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    if n_entries > GROUP_ENTRIES:
        sizes = running_sum(sizes, "uid", "n", "before", n_items).rows
        sizes, _ = stage(sizes.select("uid", F.floor(F.col("before") / GROUP_ENTRIES).alias("set")))
    found = []
    for number in range(math.ceil(n_entries / GROUP_ENTRIES)):
        own = weighted if n_entries <= GROUP_ENTRIES else weighted.join(sizes.where(F.col("set") == number), "uid", "left_semi")
        queries = spark.sparkContext.broadcast(_queries(own.toArrow()))
        found.append(index.blocks.mapInArrow(functools.partial(_search, queries=queries, k=k), "uid long, doc_id long, score long"))
    if not found:
        found = [named.limit(0).select("uid", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))]
    # First the best of a part of an item's rows, then the best of these.
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = union_all(found).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for keys in (["uid", "part"], ["uid"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return ranked.join(named.select("uid", "item"), "uid").select(F.col("item").alias(item_id), "rank", "doc_id", "score")


def _queries(entries: pa.Table) -> Queries:
    entries = entries.combine_chunks().sort_by("uid")
    terms = entries["term"].combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    uids = entries["uid"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], uids[1:] != uids[:-1]))) if len(uids) else np.empty(0, np.int64)
    cut = [(int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(uids)], strict=False)]
    places, weights = terms.indices.to_numpy().astype(np.int64), entries["weight"].to_numpy()
    return Queries(terms.dictionary.to_pylist(), uids[starts].tolist(), [places[a:b] for a, b in cut], [weights[a:b] for a, b in cut])
