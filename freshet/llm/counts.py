"""Token counts without a shuffle of pre-tokens: a two-tier lookup on the map side.

The first tier holds the lengths of frequent pre-tokens, found by adding up a bounded
list of local favourites from every task; it is broadcast.  What is not in it is encoded
once and kept in a cache of the worker.  The first tier only saves work: counts do not
depend on it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import byte_slices, like, modest_batches

FREQUENT = 32_768
LOCAL_FREQUENT = 4_096
# Entries of a worker's second tier before it starts anew, and the longest key it keeps.
CACHE_ENTRIES = 400_000
CACHE_KEY_CHARS = 64

# A pre-token is a run of blanks with the word after it; a line feed stands alone.
_PRETOKEN = re.compile(r"\n| *[^ \n]+| +")


@lru_cache(maxsize=2)
def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The model of a file that every worker has.

    Refuses a vocabulary in which a piece reaches over a pre-token's end: then the count
    of a text would not be the sum over its pre-tokens.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or re.search("[^▁]▁", piece):
            raise ValueError(f"{model_path}: piece {piece!r} reaches over a pre-token's end")
    return model


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the blank the model puts before it; none for no text."""
    return _PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def lengths(pieces: list[str], model_path: str) -> list[int]:
    """Tokens of each pre-token.

    A line feed in front keeps the model's own blank away from the pre-token; it and the
    blank are two tokens more.
    """
    return [len(ids) - 2 for ids in processor(model_path).encode([f"\n{x}" for x in pieces], num_threads=1)]


class TwoTier(dict):
    """Pre-token lengths: a fixed first tier, and what this worker has met besides."""

    def __init__(self, first: dict[str, int], model_path: str):
        super().__init__(first)
        self.first, self.model_path = first, model_path

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what is in neither tier, all in one call."""
        if len(self) > len(self.first) + CACHE_ENTRIES:
            self.clear()
            self.update(self.first)
        new = list({piece for pieces in texts for piece in pieces if piece not in self})
        self.update(zip(new, lengths(new, self.model_path), strict=True))

    def totals(self, texts: list[str]) -> list[int]:
        split = [pretokens(x) for x in texts]
        self.learn(split)
        made = [sum(map(self.__getitem__, pieces)) for pieces in split]
        for piece in {x for pieces in split for x in pieces if len(x) > CACHE_KEY_CHARS}:
            self.pop(piece, None)
        return made


def frequent_pretokens(df: DataFrame, text: str = "text", n: int = FREQUENT, local: int = LOCAL_FREQUENT) -> list[str]:
    """The most frequent pre-tokens of the whole column, ``n`` at most.

    Every task reads all its texts and gives its ``local`` most frequent; a task that
    meets very many rare ones forgets them from time to time.
    """

    def favourites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(x for x in pretokens(value.as_py() or "") if len(x) <= CACHE_KEY_CHARS)
                if len(seen) > CACHE_ENTRIES:
                    seen = Counter(dict(seen.most_common(CACHE_ENTRIES // 2)))
        top = seen.most_common(local)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"]
        )

    counted = df.select(text).mapInArrow(favourites, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(n).collect()]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append long ``out``, the tokens of each whole text; null and empty texts have 0.

    Rows and other columns stay as they are; a column named ``out`` is replaced.
    """
    modest_batches(df.sparkSession)
    df = df.drop(out)
    schema = like(df, out, T.LongType())
    frequent = frequent_pretokens(df, text)
    table = dict(zip(frequent, lengths(frequent, model_path), strict=True)) if frequent else {}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = TwoTier(shared.value, model_path)
        for batch in batches:
            column, totals = batch.column(text), []
            for at, rows in byte_slices(column):
                totals += tiers.totals([x or "" for x in column.slice(at, rows).to_pylist()])
            made = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(count, schema)
