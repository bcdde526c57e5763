"""Exact duplicates by recipes of content-defined chunks.

A text is cut where its own content says so: after the first sentence or line end beyond
``LEAST`` characters, at ``MOST`` at the latest.  Equal pieces get one identifier, so a text
becomes a short ordered list of identifiers, its recipe, and texts are equal exactly if their
recipes are.  An identifier is the hash of its chunk plus its number among the chunks of that
hash: chunks are compared by their whole content, and a hash that two different chunks share
numbers them apart.  Each distinct chunk moves once, its copies collapse before the shuffle;
after that only recipes move, some bytes for a thousand characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import hold, lower_ascii, text_of
from freshet.operators.skew import ROWS_PER_TASK, HotKeys, spread_join
from freshet.session import stage

LEAST, MOST = 512, 2048
CUT = rf"(?s).{{{LEAST},{MOST - 2}}}?[.!?\n]\s|.{{1,{MOST}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; together they are the text, the empty text has none."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def shared_hashes(texts: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, int]:
    """``(hash, chunk, number)`` of chunks that share their hash with a lesser chunk, and how many.

    All distinct chunks are compared by content.  ``texts`` has a column ``text``.
    """
    chunks = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    chunks = chunks.select("chunk", identify(F.col("chunk")).alias("hash")).distinct()
    shared, n = stage(chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    if not n:
        return shared.select("hash", F.lit("").alias("chunk"), F.lit(0).alias("number")), 0
    in_order = Window.partitionBy("hash").orderBy("chunk")
    numbered = chunks.join(shared, "hash").withColumn("number", F.row_number().over(in_order) - 1)
    return stage(numbered.where("number > 0"))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    identify: Callable[[Column], Column] = F.xxhash64,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, then ``carry``.

    Texts are equal if identical after A-Z are lower-cased; a null text counts as empty, so all
    null, empty and no other texts form a group.  Of a group the row with the largest id stays, a
    null id being less than any; of rows that repeat that id one stays.  An empty table gives
    an empty result.  Columns of ``docs`` that are not named play no part, whatever their names.
    """
    low = lower_ascii(text_of(text))
    clashes, n_clashes = shared_hashes(docs.select(low.alias("text")), identify)

    # Columns of the input only live inside a struct, so their names cannot clash.
    rows = docs.select(
        F.struct(F.col(doc_id).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"),
        F.monotonically_increasing_id().alias("uid"),
        low.alias("low"),
    )
    apart = F.array().cast("array<struct<at:int,number:int>>")
    rows = hold(rows, "text", F.col("low")).drop("low")
    if n_clashes:
        rows, _ = stage(rows)
        places = rows.select("uid", F.posexplode(chunks_of(F.col("text"))).alias("at", "chunk"))
        places = places.withColumn("hash", identify(F.col("chunk"))).join(clashes, ["hash", "chunk"])
        numbers = places.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("apart"))
        rows = rows.join(numbers, "uid", "left")
        apart = F.coalesce("apart", apart)
    hashes = F.transform(chunks_of(F.col("text")), lambda chunk: identify(chunk))
    rows = rows.select(
        "row", "uid", F.sha2("text", 256).alias("sha"), F.struct(hashes.alias("hashes"), apart.alias("apart")).alias("recipe")
    )
    rows, _ = stage(rows)

    last = F.max(F.struct(F.col("row.id").alias("id"), "uid"))
    groups = rows.groupBy("recipe").agg(last.alias("last"), F.count(F.lit(1)).alias("size"))
    groups, _ = stage(groups.where("size > 1"))
    salts = F.ceil(F.col("size") / rows_per_task).cast("int").alias("_salts")
    hot = HotKeys(*stage(groups.select("recipe", salts).where("_salts > 1")))
    known = spread_join(rows, groups, "recipe", "left", ["uid"], hot)
    alone = F.col("size").isNull()
    return known.select(
        F.col("row.id").alias(doc_id),
        F.when(alone, F.col("row.id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("last.uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
    )
