"""Byte-level BPE over long texts by overlapping chunks, and decoding back to bytes.

A long text is cut into chunks that overlap, each chunk is pre-tokenised on its own, and
two neighbours are stitched where their pre-token boundaries meet again: from there on
both agree.  The text between two such places is encoded as a piece.  Chunks keep the
work on one text in small steps; texts themselves are spread over the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from freshet.llm.common import like, modest_batches

CHUNK = 32_768
OVERLAP = 512


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; ``ranks_path`` is a file that every worker has."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pretokens(pattern: str) -> Callable[[str], Iterator]:
    return regex.compile(pattern).finditer


def _starts(pattern: str, text: str, at: int, end: int) -> list[int]:
    """Where pre-tokens start in ``text[at:end]`` when it is split on its own."""
    return [at + m.start() for m in _pretokens(pattern)(text[at:end])]


def stitched(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Cut ``text`` at true pre-token boundaries, about every ``chunk`` characters.

    A boundary counts if both chunks have it in their overlap and no white space stands
    before it: how white space splits depends on what comes after.  Where two chunks
    do not agree, the left one is pre-tokenised on through the right one and twice as far.
    """
    if len(text) <= chunk + overlap:
        return [text] if text else []
    pieces, done = [], 0  # text before ``done`` is cut off; ``done`` is a true boundary
    border, step = chunk, chunk
    while border < len(text):
        stop = min(len(text), border + overlap)
        left = {x for x in _starts(pattern, text, done, stop) if x > done and x >= border - overlap}
        right = _starts(pattern, text, max(done, border - overlap), stop)
        meet = next((x for x in right if x in left and not text[x - 1].isspace()), None)
        if meet is not None:
            pieces.append(text[done:meet])
            done = meet
        step = 2 * step if meet is None else chunk
        border += step
    pieces.append(text[done:])
    return pieces


def encode_text(text: str, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a whole text, as the library would give them without special tokens."""
    encoder = encoding(ranks_path, pattern)
    ids = [encoder.encode_ordinary(piece) for piece in stitched(text, pattern, chunk, overlap)]
    return np.fromiter((i for piece in ids for i in piece), np.int32, sum(map(len, ids)))


def _each_batch(df: DataFrame, source: str, out: str, kind: T.DataType, convert: Callable) -> DataFrame:
    """Append a column that ``convert`` makes of an Arrow array, in slices of rows."""
    modest_batches(df.sparkSession)
    df = df.drop(out) if out != source else df
    schema = like(df, out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                made = convert(batch.column(source))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append ``out``, the ids of each whole text; null and empty texts get none.

    Rows and other columns stay as they are; a column named ``out`` is replaced.
    """

    def convert(texts: pa.Array) -> pa.Array:
        ids = [encode_text(x or "", ranks_path, pattern) for x in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        values = np.concatenate([*ids, np.empty(0, np.int32)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

    return _each_batch(df, text, out, T.ArrayType(T.IntegerType()), convert)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``, the raw bytes of all ids one after another; a null list gives none."""

    def convert(lists: pa.Array) -> pa.Array:
        encoder = encoding(ranks_path, pattern)
        made = [encoder.decode_bytes(x.as_py() or []) for x in lists]
        return pa.array(made, pa.binary())

    return _each_batch(df, ids, out, T.BinaryType(), convert)
