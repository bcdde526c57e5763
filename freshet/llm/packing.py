"""Packing of documents into windows by non-negative least squares.

Documents longer than a window fill whole windows; what remains of them is shorter.
Combinations of up to four remainders that fill a window are enumerated over length
classes, and non-negative least squares finds how often to use each so that the
histogram of classes is met.  The counts are rounded down and dealt to documents.  Each
such window is filled to the last token by cutting its longest document.  What is cut
off and what the rounding leaves is packed greedily, one after another, and the very
last window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm.common import byte_slices, modest_batches, running_sum
from freshet.session import stage

WINDOW = 4096
CLASSES = 128
PARTS = 4
BLOCK_ROWS = 50_000
CACHE_ENTRIES = 600_000
CACHE_KEY_CHARS = 64


# Token ids ------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class WordIds(dict):
    """Ids of words as bytes, as this worker has met them; words are in lower case."""

    def __init__(self, path: str, width: str):
        super().__init__()
        self.path, self.width, self.code = path, width, {"<u2": "H", "<u4": "I"}[width]

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters from a to z are whole pre-tokens and go to the model directly."""
        tokenizer = _tokenizer(self.path)
        model, made, others = tokenizer.model, {}, []
        for word in words:
            if word.isalpha() and word.islower() and len(word) <= CACHE_KEY_CHARS:
                made[word] = array(self.code, [t.id for t in model.tokenize(word.decode())]).tobytes()
            else:
                others.append(word)
        ids = tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        return made | {w: np.array(x.ids, self.width).tobytes() for w, x in zip(others, ids, strict=True)}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encode the words that are not known yet, all in one call.

        A comma or full stop after a letter from a to z is a token sequence of its own.
        """
        if len(self) > CACHE_ENTRIES:
            # Words met first are the frequent ones.
            kept = dict(islice(self.items(), CACHE_ENTRIES // 2))
            self.clear()
            self.update(kept)
        new = {word for words in texts for word in words if word not in self}
        stems = {w: w[:-1] for w in new if w[-1:] in (b",", b".") and 97 <= (w[-2:-1] or b" ")[0] <= 122}
        ids = self.encoded(list({stems.get(w, w) for w in new} | {b",", b"."}))
        for word in new:
            self[word] = ids[stems[word]] + ids[word[-1:]] if word in stems else ids[word]

    def forget_long(self) -> None:
        for word in [w for w in self if len(w) > CACHE_KEY_CHARS]:
            del self[word]


@lru_cache(maxsize=2)
def known_words(path: str, width: str) -> WordIds:
    """This worker's words; refuses a tokenizer whose ids are not those of its words."""
    known, tokenizer = WordIds(path, width), _tokenizer(path)
    for probe in ("Ab, cD.\n e's\tF, 1.2 g..", "\u00c9a, b\u0301. \x0b ,x\r.y", "the hotdogs unbelievably"):
        words = probe.lower().split()
        known.learn([[w.encode() for w in words]])
        made = b"".join(known[w.encode()] for w in words)
        if made != np.array(tokenizer.encode(probe, add_special_tokens=False).ids, width).tobytes():
            raise ValueError(f"{path}: ids of a text are not those of its words")
    return known


def words_of_text(text: bytes | None) -> list[bytes]:
    """Words in lower case; text that may hold a special token is left as it is."""
    text = text or b""
    return (text if b"<|" in text else text.lower()).split()


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``(uid, doc_id, ids, n)``: the ids of each whole text and ``end_id``, as packed integers.

    For tokenizers that ignore white space and case: a text's ids are those of its words,
    and words are encoded once per worker.  A null text is empty.
    """
    width = "<u2" if _tokenizer(tokenizer_path).get_vocab_size() <= 2**16 and end_id < 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = known_words(tokenizer_path, width)
        end = np.array([end_id], width).tobytes()
        for whole in batches:
            for at, rows in byte_slices(whole.column("text"), 4_000_000):
                batch = whole.slice(at, rows)
                # White space of the ASCII range only: bytes split at no other.
                texts = [words_of_text(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                known.learn(texts)
                made = [b"".join([*map(known.__getitem__, words), end]) for words in texts]
                known.forget_long()
                size = np.dtype(width).itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(made, pa.binary()), pa.array([len(x) // size for x in made], pa.int64())],
                    ["doc_id", "ids", "n"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(run, "doc_id long, ids binary, n long")
    return made.withColumn("uid", F.monotonically_increasing_id())


# The plan -------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by the active-set method: least |ax - b| with x >= 0."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active.append(best)
        while active:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            low = z <= 0
            step = float((now[low] / np.maximum(now[low] - z[low], 1e-300)).min())
            now = now + step * (z - now)
            now[low & (now <= 1e-12)] = 0
            now[np.flatnonzero(low)[now[low].argmin()]] = 0
            x[:] = 0
            x[active] = now
            active = [j for j in active if x[j] > 0]
    return x


def combinations(classes: int = CLASSES, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Length classes, least first, of 2 to ``parts`` remainders that fill a window together."""
    found = []
    for k in range(2, parts + 1):
        for head in combinations_with_replacement(range(1, classes), k - 1):
            last = classes - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


def solve_counts(histogram: np.ndarray, patterns: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and whole counts that use no class more often than ``histogram`` has it."""
    if not histogram.sum():
        return []
    usable = [p for p in patterns if all(histogram[c] for c in p)]
    if not usable:
        return []
    a = np.zeros((len(histogram), len(usable)))
    for j, p in enumerate(usable):
        for c in p:
            a[c, j] += 1
    scale = float(histogram.max())
    counts = np.floor(nnls(a, histogram / scale) * scale + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    chosen = []
    for j in np.argsort(-counts, kind="stable"):
        need = a[:, j].astype(np.int64)
        n = min(int(counts[j]), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            chosen.append((usable[j], n))
    return chosen


def plan_pieces(lengths: DataFrame, window: int = WINDOW, classes: int = CLASSES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces ``(uid, start, length, sequence_id, offset)`` for a stored ``(uid, n)``.

    Each of the ``n`` tokens lies in exactly one piece.  ``uid`` is unique and not null.
    All sums and ranks run in blocks of about ``block_rows`` rows; the driver sees only
    the histogram.
    """
    spark = lengths.sparkSession
    unit = window // classes
    n_rows = lengths.count()
    sized = lengths.select(
        "uid",
        F.col("n"),
        F.floor(F.col("n") / window).cast("long").alias("full"),
        (F.col("n") % window).alias("rest"),
        F.floor((F.col("n") % window) / unit).cast("int").alias("class"),
    )
    histogram = np.zeros(classes, np.int64)
    for row in sized.where("class > 0").groupBy("class").count().collect():  # a row per class
        histogram[row["class"]] = row["count"]
    chosen = solve_counts(histogram, combinations(classes))

    # Whole windows of long documents come first.
    full = running_sum(sized.select("uid", "full"), "uid", "full", "first", n_rows, block_rows)
    pieces_full = full.rows.where("full > 0").select(
        "uid", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("i"), "first"
    ).select(
        "uid",
        (F.col("i") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        (F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    # Then the patterns.  Slots of a class are numbered through; a document's rank in its
    # class is its slot.
    slots, taken, base = [], np.zeros(classes, np.int64), full.total
    for pattern, times in chosen:
        for place, c in enumerate(pattern):
            lo = int(taken[c])
            taken[c] += times
            slots.append((int(c), lo, lo + times, base, place, len(pattern)))
        base += times
    slot_table = spark.createDataFrame(slots, "class int, lo long, hi long, base long, place int, parts int")
    n_blocks = max(1, -(-n_rows // block_rows))
    rests = sized.where("rest > 0").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)))
    inside = Window.partitionBy("class", "block").orderBy("uid")
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rests.groupBy("class", "block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .drop("rows")
    )
    ranked = (
        rests.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["class", "block"])
        .withColumn("rank", F.col("rank") + F.col("ahead"))
    )
    # A row per class and pattern, a few hundred at most.
    dealt = ranked.join(F.broadcast(slot_table), "class", "left").where(
        "lo is null or (rank >= lo and rank < hi)"
    )
    placed = dealt.where("lo is not null").select(
        "uid", "n", "rest", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "place"
    )
    # The longest comes last and is cut at the window's end.
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed, _ = stage(
        placed.withColumn("offset", F.coalesce(F.sum("rest").over(ahead), F.lit(0)))
        .withColumn("start", F.col("n") - F.col("rest"))
        .withColumn("length", F.least(F.col("rest"), window - F.col("offset")))
        .select("uid", "start", "length", "sequence_id", "offset", "rest")
    )
    crumbs = placed.where("rest > length").select(
        "uid", (F.col("start") + F.col("length")).alias("start"), (F.col("rest") - F.col("length")).alias("length")
    )
    n_slots = F.lit(taken.tolist())
    unplaced = ranked.where(F.col("rank") >= F.get(n_slots, F.col("class"))).select(
        "uid", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length")
    )
    # A document leaves one residual at most, so ``uid`` stays unique.
    residual, n_residual = stage(unplaced.unionByName(crumbs))
    stream = running_sum(residual, "uid", "length", "at", n_residual, block_rows)
    windows = stream.total // window
    bounds = [windows * window]
    for bit in reversed(range(window.bit_length())):
        if (stream.total % window) >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    end = F.col("at") + F.col("length")
    whole = F.transform(
        F.sequence(F.floor(F.col("at") / window).cast("long"), F.floor((end - 1) / window).cast("long")),
        lambda w: F.struct(w.alias("seq"), (w * window).alias("lo"), ((w + 1) * window).alias("hi")),
    )
    last = F.array(
        *(
            F.struct(F.lit(windows + i).cast("long").alias("seq"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
            for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))
        )
    )
    cuts = F.filter(whole, lambda c: c["seq"] < windows)
    if len(bounds) > 1:
        cuts = F.concat(cuts, F.filter(last, lambda c: (c["lo"] < end) & (c["hi"] > F.col("at"))))
    lo, hi = F.greatest(F.col("c.lo"), F.col("at")), F.least(F.col("c.hi"), end)
    pieces_stream = stream.rows.select("uid", "start", "length", "at", F.explode(cuts).alias("c")).select(
        "uid",
        (F.col("start") + lo - F.col("at")).alias("start"),
        (hi - lo).alias("length"),
        (F.col("c.seq") + base).alias("sequence_id"),
        (lo - F.col("c.lo")).alias("offset"),
    )
    pieces_placed = placed.select("uid", "start", "length", "sequence_id", "offset")
    return pieces_full.unionByName(pieces_placed).unionByName(pieces_stream)


# The whole ------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` of all documents.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.  A null or
    empty text is packed as its end id alone; repeated rows and rows without an id are
    packed like any other; other columns are not read.  An empty table gives no piece.
    """
    modest_batches(docs.sparkSession)
    tokens, _ = stage(token_ids(docs, tokenizer_path, end_id))
    pieces = plan_pieces(tokens.select("uid", "n"), window)
    # A document's pieces go to its ids together: one row a document on either side.
    per_doc = pieces.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, blobs, totals, plans = (batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "pieces"))
            for at in range(0, len(blobs), 500):
                rows = []
                for doc_id, blob, n, plan in zip(*(x[at : at + 500] for x in (doc_ids, blobs, totals, plans)), strict=True):
                    ids = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4")
                    for p in plan:
                        start, length = p["start"], p["length"]
                        rows.append((doc_id, start, length, n, p["sequence_id"], p["offset"], ids[start : start + length].tobytes()))
                kinds = [pa.int64()] * 6 + [pa.binary()]
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = tokens.join(per_doc, "uid").select("doc_id", "ids", "n", "pieces")
    return joined.mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
