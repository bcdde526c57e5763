"""Prediction by partial matching: a byte-context trie learned from the corpus scores texts.

The corpus is counted once in windows of ``order`` + 1 symbols; shorter contexts are sums
over longer ones.  A symbol is a byte or 256, which ends a text and fills the context
before its start.  All windows stay, as a stored table that grows with the corpus
(``learn``).  Frequent ones are broadcast with their scores; the others are gathered once
for a block of neighbouring texts and scored where all windows of their last ``SPLIT``
context symbols meet (``meet``, ``settle``).
``train`` makes a model that fits a node: it leaves windows that hold less than 1 / ``nodes``
of all positions of their order to the shorter contexts.

Each window gives ``DISCOUNT`` of its count to the escape: a context seen ``t`` times with
``d`` different symbols escapes with DISCOUNT * d / t, and symbols that a longer context
has offered are excluded from the shorter ones.  What a context offers, its suffix offers too, so the symbols excluded at a
context are those of the next longer one, and all sums are known when the model is built.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import byte_slices, fresh, modest_batches, partitions, text_of
from freshet.session import stage

ORDER = 5
NODES = 1 << 20
BITS = 9
END = 256
SYMBOLS = 257
# Taken from the count of each window and given to its context's escape.
DISCOUNT = 0.5
# Symbols that are worked on at once.
STEP = 1 << 18
# Windows meet by so many symbols of their context; the levels below are on every node.
SPLIT = 3
# About as many windows as a task should hold.
TASK_WINDOWS = 1 << 20
# The windows of a small corpus are dealt into so many parts; askers of a part are parted further.
LEAST_PARTS = 8
# Times a context of ``SPLIT`` symbols this fits 63 bits.
MIX = 0x9E3779B1
# A block of texts ends when it has so many entries of a rare window and a text.
BLOCK_ENTRIES = 1 << 18
# Windows that tasks have counted are added up in so many ranges at least.
LEAST_RANGES = 128
# Distinct windows of the pieces so far that a worker holds while it counts.
HELD = 1 << 19
# Bytes of text that a worker cuts into windows or words at once.
PIECE = 500_000
# Bytes of distinct words, or of packed windows, that a worker holds while it counts.
HELD_BYTES = 8_000_000

_LOWER = np.arange(256, dtype=np.uint16)
_LOWER[65:91] += 32


# Symbols and windows ----------------------------------------------------------------


def framed(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of symbols, lower-cased, and where each text ends in it.

    ``order`` end symbols stand before each text and one after it.
    """
    column = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    symbols = np.full(len(data) + (order + 1) * len(sizes), END, np.uint16)
    ends = offsets[1:] + np.arange(1, len(sizes) + 1) * (order + 1)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    for i in range(order):
        inside[ends - 2 - sizes - i] = False
    symbols[inside] = _LOWER[data]
    return symbols, ends


def windows(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each symbol from place ``order`` on, it and the ``order`` before it as one number."""
    n = len(symbols) - order
    codes = np.zeros(max(0, n), np.int64)
    for i in range(order + 1):
        codes <<= BITS
        codes |= symbols[i : i + max(0, n)]
    return codes


def _starts_inside(codes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """True where a window predicts a symbol of a text, not one of the end symbols before it."""
    real = np.ones(len(codes), bool)
    for at in ends[:-1]:
        real[at - order : at] = False
    return real


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending windows and their counts from several such lists; empties the list of them."""
    codes = np.concatenate([c for c, _ in held])
    counts = np.concatenate([n for _, n in held])
    held.clear()
    order_of = np.argsort(codes, kind="stable")
    codes, counts = codes[order_of], counts[order_of]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending windows of a task's texts and their counts, in as few lists as a worker can hold."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for at, rows in byte_slices(batch.column(0), PIECE):
            symbols, ends = framed(batch.column(0).slice(at, rows), order)
            real = _starts_inside(symbols[order:], ends, order)
            # In steps: one text may be long.
            for lo in range(0, len(real), STEP):
                codes = windows(symbols[lo : lo + STEP + order], order)
                held.append(np.unique(codes[real[lo : lo + STEP]], return_counts=True))
                if sum(len(c) for c, _ in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield held.pop()
    if held:
        yield merged(held)


def count_windows(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(window, n)`` over all texts; tasks add up theirs before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in counted(batches, order):
            yield _pairs(codes, counts)

    return texts.select(text_of()).mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _packed(codes: np.ndarray, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    return len(codes), _squeezed(np.diff(codes, prepend=0)), _squeezed(counts)


def _added(lists: Iterable[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and counts of packed lists, which are opened a few at a time."""
    held, size, whole = [], 0, 0
    for n, codes, counts in lists:
        held.append((np.cumsum(_restored(codes, n, np.int64)), _restored(counts, n, np.int64)))
        size += n
        if size > max(HELD, 2 * whole):
            held = [merged(held)]
            size = whole = len(held[0][0])
    return merged(held)


def add_windows(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``count_windows`` for many texts: what tasks have counted is packed by ranges of a hash, and added up range by range.

    A worker holds ``HELD_BYTES`` of packed lists before it sends them, and adds up those of a range.  A
    range's lists are one group, opened a few at a time; its distinct windows are held.
    """
    n_ranges = max(LEAST_RANGES, partitions(texts.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, bytes, bytes]]] = defaultdict(list)

        def sent() -> pa.RecordBatch:
            sizes, codes, counts = zip(*(x[0] if len(x) == 1 else _packed(*_added(x)) for x in kept.values()), strict=True)
            columns = [pa.array(kept, pa.int32()), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())]
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, ["dealt", "size", "windows", "counts"])

        for codes, counts in counted(batches, order):
            mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            dealt = (mixed * np.uint64(n_ranges) >> np.uint64(31)).astype(np.min_scalar_type(n_ranges))
            order_of = np.argsort(dealt, kind="stable")
            dealt, codes, counts = dealt[order_of], codes[order_of], counts[order_of]
            cuts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
            for a, b in pairwise(cuts.tolist()):
                kept[int(dealt[a])].append(_packed(codes[a:b], counts[a:b]))
            if sum(len(x) + len(y) for lists in kept.values() for _, x, y in lists) > HELD_BYTES:
                yield sent()
        if kept:
            yield sent()

    def add(packed: pa.Table) -> pa.Table:
        codes, counts = _added(tuple(packed[x][i].as_py() for x in ("size", "windows", "counts")) for i in range(packed.num_rows))
        return pa.table({"window": codes, "n": counts})

    packed = texts.select(text_of()).mapInArrow(run, "dealt int, size int, windows binary, counts binary")
    return packed.groupBy("dealt").applyInArrow(add, "window long, n long")


def _pairs(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["window", "n"])


# The model ---------------------------------------------------------------------------


@dataclass
class Table:
    """Sorted keys with values, found through a hash table of twice to four times their number."""

    keys: np.ndarray
    values: dict[str, np.ndarray]
    _slots: np.ndarray | None = field(default=None, repr=False)

    def _hash(self, keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """``find`` for ascending keys, by bisection: next to no place is far from the one before."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for those that are not in it."""
        bits = max(4, len(self.keys).bit_length() + 1)
        mask = (1 << bits) - 1
        if self._slots is None:
            self._slots = np.full(1 << bits, -1, np.int32)
            todo, at = np.arange(len(self.keys), dtype=np.int32), self._hash(self.keys, bits)
            while len(todo):
                free = self._slots[at] < 0
                self._slots[at[free]] = todo[free]
                lost = self._slots[at] != todo
                todo, at = todo[lost], (at[lost] + 1) & mask
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        todo, at = np.arange(len(keys)), self._hash(keys, bits)
        while len(todo):
            slot = self._slots[at]
            hit = slot >= 0
            same = hit & (self.keys[slot] == keys[todo])
            found[todo[same]] = slot[same]
            more = hit & ~same
            todo, at = todo[more], (at[more] + 1) & mask
        return found


@dataclass
class Model:
    """Windows and contexts of each order, with what a score needs of them.

    ``grams[k]``: windows of order ``k``, how often they occur (``n``) and, on arrival at
    their own context, the log10 probability of their last symbol (``log``).
    ``contexts[k]``: ``esc``, the log10 escape on arrival at the context itself; ``down_den``
    and ``down_esc``, denominator and escape at its suffix after an escape from here.
    """

    order: int
    grams: list[Table]
    contexts: list[Table]
    # Symbols that the empty context does not offer share what is left.
    floor: float

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each window, given the symbols before it."""
        place = self.grams[self.order].find(codes)
        score = np.where(place >= 0, self.grams[self.order].values["log"][place], 0.0) if self.grams[self.order].keys.size else np.zeros(len(codes))
        todo = np.flatnonzero(place < 0)
        den, esc = np.zeros(len(todo)), np.zeros(len(todo))
        arrived = np.zeros(len(todo), bool)
        for k in range(self.order, -1, -1):
            gram = codes[todo] & ((1 << BITS * (k + 1)) - 1)
            own = self.grams[k].values
            place = self.grams[k].find(gram) if k < self.order else np.full(len(todo), -1)
            hit = place >= 0
            fresh, later = hit & ~arrived, hit & arrived
            score[todo[fresh]] += own["log"][place[fresh]]
            score[todo[later]] += np.log10((own["n"][place[later]] - DISCOUNT) / den[later])
            todo, den, esc, arrived, gram = (x[~hit] for x in (todo, den, esc, arrived, gram))
            at = self.contexts[k].find(gram >> BITS)
            known = at >= 0
            values, at = self.contexts[k].values, at[known]
            score[todo[known]] += np.where(arrived[known], esc[known], values["esc"][at])
            if k:
                den[known], esc[known] = values["down_den"][at], values["down_esc"][at]
            arrived |= known
        score[todo] += self.floor
        return score


def _log_share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    # A context that offers nothing new is passed through.
    return np.where(part > 0, np.log10(np.maximum(part, 1e-300) / np.maximum(whole, 1e-300)), 0.0)


def build(levels: list[tuple[np.ndarray, np.ndarray]], lower: Model | None = None) -> Model:
    """A model from windows and counts of each order, shortest first; order 0 is complete.

    A context occurs as often as it does as a window one order lower; what its kept
    windows do not make up of that goes to its escape.  On top of a ``lower`` model,
    ``levels`` hold all windows of each of their contexts.
    """
    grams, contexts = ([*lower.grams], [*lower.contexts]) if lower else ([], [])
    for k, (codes, counts) in enumerate(levels, len(grams)):
        order = np.argsort(codes)
        grams.append(Table(codes[order], {"n": counts[order].astype(np.float64)}))
        keys, at = np.unique(grams[k].keys >> BITS, return_inverse=True)
        n = grams[k].values["n"]
        kept = np.bincount(at, n, len(keys))
        kinds = np.bincount(at, minlength=len(keys)).astype(np.float64)
        if k and not lower:
            # The context of end symbols alone stands before each text; others end in a byte.
            ends = grams[0].values["n"][grams[0].keys == END].sum()
            total = np.where(keys & ((1 << BITS) - 1) == END, ends, grams[k - 1].values["n"][grams[k - 1].find(keys)])
        else:
            total = kept
        table = Table(keys, {"total": total, "kept": kept, "kinds": kinds})
        table.values["esc"] = _log_share(total - kept + DISCOUNT * kinds, total)
        grams[k].values["log"] = np.log10((n - DISCOUNT) / total[at])
        if k:
            suffix = grams[k - 1].find(grams[k].keys & ((1 << BITS * k) - 1))
            offered = np.bincount(at, grams[k - 1].values["n"][suffix], len(keys))
            up, parent = contexts[k - 1].values, contexts[k - 1].find(keys & ((1 << BITS * (k - 1)) - 1))
            # Excluded symbols leave with all their weight but the discount, which stays for the escape.
            rest, new = up["total"][parent] - offered, up["kinds"][parent] - kinds
            missing = up["total"][parent] - up["kept"][parent]
            table.values["down_den"] = rest
            table.values["down_esc"] = _log_share(missing + DISCOUNT * new, rest)
        contexts.append(table)
    left = SYMBOLS - len(grams[0].keys)
    return Model(len(grams) - 1, grams, contexts, -float(np.log10(max(1, left))))


def train(texts: DataFrame, order: int = ORDER, nodes: int = NODES) -> Model:
    """Learn from all rows of ``texts``; the driver gets ``nodes`` windows of each order at most."""
    modest_batches(texts.sparkSession)
    counted, _ = stage(count_windows(texts, order))
    n = counted.agg(F.sum("n")).first()[0] or 0
    masks = F.array(*(F.lit((1 << BITS * (k + 1)) - 1).cast("long") for k in range(order + 1)))
    kept = (
        counted.select(F.posexplode(masks).alias("order", "mask"), "window", "n")
        .groupBy("order", F.col("window").bitwiseAND(F.col("mask")).alias("window"))
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") * nodes >= n) | (F.col("order") == 0))
    )
    rows = kept.toPandas()
    levels = []
    for k in range(order + 1):
        part = rows[rows["order"] == k]
        levels.append((part["window"].to_numpy(np.int64), part["n"].to_numpy(np.int64)))
    return build(levels)


@dataclass
class Corpus:
    """All windows of a corpus, stored as ``counts (window, n)``.

    ``lower`` has the levels below ``split``, of which there are 257 ** ``split`` windows
    at most.  ``frequent`` has windows of the full order and their ``log``.
    """

    counts: DataFrame
    n_windows: int
    order: int
    split: int
    lower: Model
    frequent: Table


def _mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def _fold(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of order ``k`` and their counts, from those of a higher order."""
    keys, at = np.unique(codes & _mask(k + 1), return_inverse=True)
    return keys, np.bincount(at, counts, len(keys))


def learn(texts: DataFrame, order: int = ORDER, nodes: int = NODES) -> Corpus:
    """Count all windows of ``texts``; ``nodes`` frequent ones at most reach the driver."""
    modest_batches(texts.sparkSession)
    split = min(SPLIT, order)
    counts, n_windows = stage(add_windows(texts, order))
    n = counts.agg(F.sum("n")).first()[0] or 0

    def pairs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        held = rows.toPandas()
        return held["window"].to_numpy(np.int64), held["n"].to_numpy(np.int64)

    def sums(code: Column) -> DataFrame:
        return counts.groupBy(code.alias("window")).agg(F.sum("n").alias("n"))

    low = pairs(sums(F.col("window").bitwiseAND(F.lit(_mask(split)))))
    lower = build([_fold(*low, k) for k in range(split)])
    often = F.col("n") * nodes >= n
    # The context of a frequent window is as frequent.
    codes, own = pairs(counts.where(often))
    order_of = np.argsort(codes)
    codes, own = codes[order_of], own[order_of]
    above, totals = pairs(sums(F.shiftright("window", BITS)).where(often))
    total = totals[Table(above, {}).find(codes >> BITS)]
    return Corpus(counts, n_windows, order, split, lower, Table(codes, {"log": np.log10((own - DISCOUNT) / total)}))


# Scores ------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """Add double ``out``, the log10 probability of each whole text and its end.

    A null text is empty: its score is that of an end at the start.  Rows are scored one by
    one; other columns stay as they are.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def made(texts: pd.Series) -> pd.Series:
        own, scores = shared.value, []
        column = pa.array(texts, pa.string())
        for at, rows in byte_slices(column):
            symbols, ends = framed(column.slice(at, rows), own.order)
            each = np.empty(max(0, len(symbols) - own.order))
            for lo in range(0, len(each), STEP):
                codes = windows(symbols[lo : lo + STEP + own.order], own.order)
                each[lo : lo + len(codes)] = own.log10(codes)
            each[~_starts_inside(each, ends, own.order)] = 0
            # The window of a text's end symbol is at ``end - 1 - order``.
            sums = np.add.reduceat(each, np.concatenate([[0], (ends - own.order)[:-1]])) if len(ends) else []
            scores.append(np.asarray(sums, float))
        return pd.Series(np.concatenate([*scores, np.empty(0)]))

    return docs.withColumn(out, made(text_of(text)))


def _squeezed(values: np.ndarray) -> bytes:
    """Values as compressed bytes, all first bytes before all second ones: most are alike."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def part_of(codes, split: int, n_parts: int):
    """The part of each window, an array or a column: by the last ``split`` symbols of its context, mixed."""
    if isinstance(codes, Column):
        context = F.shiftright(codes, BITS).bitwiseAND(F.lit(_mask(split)))
        return F.shiftright(context * F.lit(MIX), 20) % n_parts
    return (((codes >> BITS) & _mask(split)) * MIX >> 20) % n_parts


def entries(codes: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window, text, n)`` of windows and the ascending numbers of their texts, by window and text.

    A window of ``bits`` bits and its text are one number to sort where both fit one.
    """
    if not len(codes):
        return codes, at, np.empty(0, np.int64)
    low = int(at[0])
    room = int(at[-1] - low).bit_length()
    if bits + room <= 64:
        both = np.sort((codes.astype(np.uint64) << np.uint64(room)) | (at - low).astype(np.uint64))
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        both = both[new]
        found, held = (both >> np.uint64(room)).astype(np.int64), (both & np.uint64((1 << room) - 1)).astype(np.int64) + low
    else:
        order = np.argsort(codes, kind="stable")
        found, held = codes[order], at[order]
        new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (held[1:] != held[:-1])))
        found, held = found[new], held[new]
    return found, held, np.diff(np.append(new, len(codes)))


class Block:
    """Rare windows of neighbouring texts: each window once, with the texts that hold it.

    Entries are ``(window, text, n)``, the text as its number in the block.
    """

    def __init__(self) -> None:
        self.first, self.texts = 0, 0
        self._codes, self._at, self._n = ([] for _ in range(3))
        self.size = 0

    def add(self, codes: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Add entries in the order of their windows, of texts that are not before those added so far."""
        self._codes.append(codes)
        self._at.append(at.astype(np.int32))
        self._n.append(n.astype(np.int32))
        self.size += len(codes)
        if len(self._codes) > 64:
            self._merge()

    def _merge(self) -> None:
        """One run of entries; a text that was cut may have left two of a window, which become one."""
        codes, at, n = (np.concatenate(x) for x in (self._codes, self._at, self._n))
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (at[1:] != at[:-1]))[: len(codes)])
        n = np.add.reduceat(n[order], new, dtype=np.int32) if len(new) else n
        self._codes, self._at, self._n, self.size = [codes[new]], [at[new]], [n], len(new)

    def cut(self, split: int, n_parts: int) -> list[dict]:
        """What each part is asked by this block; empties the block."""
        if not self.size:
            return []
        self._merge()
        codes, at, n = self._codes[0], self._at[0], self._n[0]
        # Numbers of two bytes are sorted by counting.
        part = part_of(codes, split, n_parts).astype(np.min_scalar_type(n_parts))
        order = np.argsort(part, kind="stable")
        part, codes, at, n = part[order], codes[order], at[order], n[order]
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
        made, lo = [], 0
        for hi in ends:
            new = np.flatnonzero(np.append(True, codes[lo + 1 : hi] != codes[lo : hi - 1]))
            held = codes[lo:hi][new]
            made.append(
                {
                    "part": int(part[lo]),
                    "first": self.first,
                    "texts": self.texts,
                    "n_windows": len(held),
                    "n_entries": int(hi - lo),
                    "windows": _squeezed(np.diff(held, prepend=0)),
                    "holders": _squeezed(np.diff(np.append(new, hi - lo)).astype(np.int32)),
                    "at": _squeezed(at[lo:hi]),
                    "n": _squeezed(n[lo:hi]),
                }
            )
            lo = hi
        self._codes, self._at, self._n, self.size = [], [], [], 0
        pa.default_memory_pool().release_unused()
        return made


# What a block asks of a part, in Arrow and in Spark.
_ASKED = pa.struct(
    [("part", pa.int32()), ("first", pa.int64()), *((x, pa.int32()) for x in ("texts", "n_windows", "n_entries"))]
    + [(x, pa.binary()) for x in ("windows", "holders", "at", "n")]
)
_ASKED_SQL = "struct<part:int,first:long,texts:int,n_windows:int,n_entries:int,windows:binary,holders:binary,at:binary,n:binary>"


def _n_parts(corpus: Corpus) -> int:
    """By the windows of the corpus alone: a text gets an answer from each part that it asks."""
    return max(LEAST_PARTS, math.ceil(corpus.n_windows / TASK_WINDOWS))


def meet(docs: DataFrame, corpus: Corpus, out: str, rare: str, text: str = "text") -> DataFrame:
    """Add double ``out``, the score of a text's frequent windows, and ``rare``, what is open.

    Neighbouring texts form blocks; the last text of a block carries its other windows, each
    once, by part of the corpus, in ``rare.asked``.  ``rare.uid`` numbers the rows.  ``settle``
    adds what these windows score; store the result before.  A null text is empty, repeated
    rows are scored each, and columns named like ``out`` or ``rare`` are replaced.
    """
    modest_batches(docs.sparkSession)
    order, split, n_parts = corpus.order, corpus.split, _n_parts(corpus)
    shared = docs.sparkSession.sparkContext.broadcast(corpus.frequent)
    rest = docs.drop(out, rare)
    # The text goes to a worker and back once, a null one as such.
    packed = rest.select(
        F.struct(*(F.col(f"`{c}`") for c in rest.columns if c != text)).alias("row"),
        F.col(f"`{text}`").alias("text"),
        F.monotonically_increasing_id().alias("uid"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, block, held = shared.value, Block(), None
        # One more for windows that have no place.
        logs = np.append(frequent.values["log"], 0.0)

        def scored(column: pa.Array, uids: np.ndarray) -> np.ndarray:
            if not block.texts:
                block.first = int(uids[0])
            symbols, ends = framed(column, order)
            sums = np.zeros(len(column))
            # Where each text's first window and the window of its end symbol are.
            lasts = ends - 1 - order
            firsts = np.append(0, ends[:-1])
            for lo in range(0, len(symbols) - order, STEP):
                codes = windows(symbols[lo : lo + STEP + order], order)
                hi = lo + len(codes)
                a, b = np.searchsorted(lasts, lo), np.searchsorted(firsts, hi)
                # Windows before a text's first one predict the symbols that stand before it.
                sizes = np.minimum(lasts[a:b] + 1, hi) - np.maximum(firsts[a:b], lo)
                starts = np.maximum(firsts[a:b], lo) - lo
                row = np.repeat(np.arange(a, b), sizes)
                inside = np.arange(len(row)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
                codes, row, n = entries(codes[inside], row, BITS * (order + 1))
                # Each window of a step is looked up once.
                new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
                place = frequent.among(codes[new])[np.cumsum(new) - 1]
                sums += np.bincount(row, logs[place] * n, len(sums))
                lost = place < 0
                block.add(codes[lost], row[lost] + (int(uids[0]) - block.first), n[lost])
            block.texts = int(uids[-1]) - block.first + 1
            return sums

        def done(piece: tuple, last: bool) -> pa.RecordBatch:
            row, text, uids, sums = piece
            asked = [None] * len(sums)
            if last:
                asked[-1] = block.cut(split, n_parts)
                block.texts = 0
            rares = pa.StructArray.from_arrays([pa.array(uids), pa.array(asked, pa.list_(_ASKED))], ["uid", "asked"])
            return pa.RecordBatch.from_arrays([row, text, pa.array(sums), rares], ["row", "text", "log", "rare"])

        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for at, rows in byte_slices(texts, PIECE):
                if held:
                    yield done(held, block.size >= BLOCK_ENTRIES)
                piece, uids = batch.slice(at, rows), batch.column("uid").slice(at, rows).to_numpy()
                held = (piece.column("row"), piece.column("text"), uids, scored(texts.slice(at, rows), uids))
        if held:
            yield done(held, True)

    own = packed.schema
    kind = f"row {own['row'].dataType.simpleString()}, text {own['text'].dataType.simpleString()}, log double, rare struct<uid:long,asked:array<{_ASKED_SQL}>>"
    met = packed.mapInArrow(run, kind)
    columns = [(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in rest.columns]
    return met.select(*columns, F.col("log").alias(out), F.col("rare").alias(rare))


def settle(docs: DataFrame, corpus: Corpus, out: str, rare: str, source: DataFrame | None = None) -> DataFrame:
    """Add the scores of the windows in ``rare`` to ``out``, by all windows of the corpus; drops ``rare``.

    Windows of the corpus and those asked for are dealt by the last ``split`` symbols of
    their context, so all that a score needs from that order on is in one task.  A context
    has 257 ** (order + 1 - split) windows of the corpus at most; parts that are asked for
    often are repeated.  ``source`` is a stored table with the same ``rare``, where ``docs``
    builds on one; without it ``docs`` is stored.
    """
    spark, order, split = corpus.counts.sparkSession, corpus.order, corpus.split
    if source is None:
        docs, _ = stage(docs)
        source = docs
    n_parts = _n_parts(corpus)
    asked = source.select(F.explode(F.col(rare)["asked"]).alias("r")).select("r.*")
    # Entries that a task should take in; they stay compressed until it comes to them.
    parts = F.ceil(F.sum("n_entries") / (4 * TASK_WINDOWS)).cast("int")
    hot, _ = stage(asked.groupBy("part").agg(parts.alias("_salts")).where("_salts > 1"))
    salts = F.coalesce("_salts", F.lit(1))

    known = corpus.counts.select("window", "n", part_of(F.col("window"), split, n_parts).cast("int").alias("part")).join(hot, "part", "left")
    known = known.select("part", "window", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("first"), salts).cast("int").alias("salt")
    asked = asked.join(hot, "part", "left").select(*asked.columns, salt)
    shared = spark.sparkContext.broadcast(corpus.lower)

    def answer(counts: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "more": pa.array([], pa.float64())})
        codes, n = counts["window"].to_numpy(), counts["n"].to_numpy()
        model = build([_fold(codes, n, k) for k in range(split, order + 1)], shared.value)
        del counts, codes, n
        rows = range(wanted.num_rows)

        def block(at: int) -> dict:
            return {name: wanted[name][at].as_py() for name in ("first", "texts", "n_windows", "n_entries", "windows", "holders", "at", "n")}

        def asked_by(b: dict) -> np.ndarray:
            return np.cumsum(_restored(b["windows"], b["n_windows"], np.int64))

        # Blocks share most of their windows; a few at a time become one list, and are taken apart again below.
        own, held, size = np.empty(0, np.int64), [], 0
        for i in rows:
            held.append(asked_by(block(i)))
            size += len(held[-1])
            if size > max(HELD, len(own)) or i == rows[-1]:
                own, held, size = np.unique(np.concatenate([own, *held])), [], 0
        logs = np.empty(len(own))
        for lo in range(0, len(own), STEP):
            logs[lo : lo + STEP] = model.log10(own[lo : lo + STEP])
        del model
        uids, sums = [], []
        for i in rows:
            b = block(i)
            held = asked_by(b)
            each = np.repeat(logs[np.searchsorted(own, held)], _restored(b["holders"], b["n_windows"], np.int32))
            at = _restored(b["at"], b["n_entries"], np.int32)
            added = np.bincount(at, each * _restored(b["n"], b["n_entries"], np.int32), b["texts"])
            some = np.flatnonzero(added)
            uids.append(some + b["first"])
            sums.append(added[some])
        return pa.table({"uid": np.concatenate(uids), "more": np.concatenate(sums)})

    pairs = known.groupBy("part", "salt").cogroup(asked.groupBy("part", "salt"))
    added = pairs.applyInArrow(answer, "uid long, more double").groupBy(F.col("uid").alias("_uid")).agg(F.sum("more").alias("_more"))
    uid, more = fresh(docs, "_uid"), fresh(docs, "_more")
    added = added.select(F.col("_uid").alias(uid), F.col("_more").alias(more))
    whole = docs.withColumn(uid, F.col(rare)["uid"]).drop(rare).join(added, uid, "left")
    return whole.withColumn(out, F.col(out) + F.coalesce(more, F.lit(0.0))).drop(uid, more)


@dataclass
class WordModel:
    """Add-one word counts: all of them as a stored table, the frequent ones at hand.

    ``total`` is N + V + 1 with one end for each training text among the tokens.
    """

    counts: DataFrame
    frequent: dict[str, float]
    ends: int
    n_tokens: int
    total: float


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts and the number of each one's text; a text's first or last may be empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy()


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of lower-cased words over all texts; tasks add up theirs before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            whole = pa.concat_tables(held)
            held.clear()
            return whole.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            for at, rows in byte_slices(batch.column(0)):
                found = split_words(batch.column(0).slice(at, rows))[0].value_counts()
                made = pa.table({"word": found.field("values"), "c": found.field("counts")})
                held.append(made.filter(pc.not_equal(made["word"], "")))
                if sum(x.nbytes for x in held) > HELD_BYTES:
                    held = [merged()]
                    if held[0].nbytes > HELD_BYTES // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return texts.select(text_of()).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_words(texts: DataFrame, frequent: int = 1 << 18) -> WordModel:
    """Count lower-cased words and ends over all rows of ``texts``.

    Of the most frequent words about ``frequent``, and not more, reach the driver.
    """
    modest_batches(texts.sparkSession)
    counts, n_kinds = stage(count_words(texts))
    ends = texts.count()
    # Words by the size of their counts, in steps of a sixteenth of a doubling.
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least"))
    steps = sorted(steps.collect(), key=lambda r: -r["step"])
    n_tokens = sum(r["c"] for r in steps) + ends
    total = float(n_tokens + n_kinds + (ends > 0) + 1)
    taken = [r["least"] for r, n in zip(steps, accumulate(r["n"] for r in steps), strict=True) if n <= frequent]
    logs: dict[str, float] = {}
    if taken:
        common = counts.where(F.col("c") >= taken[-1]).toPandas()
        values = np.log10((common["c"].to_numpy(np.float64) + 1) / total)
        logs = dict(zip(common["word"], values.tolist(), strict=True))
    return WordModel(counts, logs, ends, n_tokens, total)


def cut_words(docs: DataFrame, model: WordModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without ``text``, with what ``add_words`` makes word scores from.

    Returns ``(row, tokens, known, log, rare, uid)``.  Frequent words are scored where the text is.
    """
    modest_batches(docs.sparkSession)
    made = ("n_tokens", "n_known", "base_score")
    rest = docs.drop(*made)
    row = rest.drop(text)
    end = (1 if model.ends else 0, float(np.log10((model.ends + 1) / model.total)))
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)
    packed = rest.select(F.struct(*row.columns).alias("row"), text_of(text).alias("text"))
    kind = f"row {row.schema.simpleString()}, tokens long, known long, log double, rare map<string,long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for whole in batches:
            for at, rows in byte_slices(whole.column("text"), PIECE):
                batch = whole.slice(at, rows)
                words, text = split_words(batch.column("text").cast(pa.string()))
                coded = words.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy()
                # Each word of a slice is looked up once.
                logs = np.array(list(map(get, words.to_numpy(zero_copy_only=False))), float)
                real = code != words.index("").as_py()
                code, text = code[real], text[real]
                each = logs[code]
                other = np.isnan(each)
                pairs, n = np.unique(text[other].astype(np.int64) * len(words) + code[other], return_counts=True)
                each[other] = 0
                tokens = np.bincount(text, minlength=rows)
                known = tokens - np.bincount(text[other], minlength=rows)
                ends = np.searchsorted(pairs, np.arange(rows + 1) * len(words))
                rare = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(pairs % max(1, len(words)))), pa.array(n, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        pa.array(tokens + 1, pa.int64()),
                        pa.array(known + end[0], pa.int64()),
                        pa.array(np.bincount(text, each, rows) + end[1], pa.float64()),
                        rare,
                    ],
                    ["row", "tokens", "known", "log", "rare"],
                )

    return packed.mapInArrow(run, kind).withColumn("uid", F.monotonically_increasing_id())


def base_scores(docs: DataFrame, model: WordModel, text: str = "text") -> DataFrame:
    """Replace ``text`` by long ``n_tokens`` and ``n_known`` and double ``base_score``.

    The score adds up log10((c + 1) / total) over words and the end.  Of words that are not
    frequent one row for each text and word is joined by word with the counts.  A null text
    is empty.  Names that clash are replaced.
    """
    return add_words(stage(cut_words(docs, model, text))[0], model)


def add_words(parts: DataFrame, model: WordModel) -> DataFrame:
    """Word scores of a stored result of ``cut_words``, beside the rows' columns."""
    each = parts.select("uid", F.explode("rare").alias("word", "n")).join(model.counts, "word", "left")
    added = each.groupBy("uid").agg(
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(model.total))).alias("more_log"),
    )
    return parts.join(added, "uid", "left").select(
        "row.*",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0))).alias("base_score"),
    )
