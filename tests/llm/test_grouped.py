"""Exact duplicates, the conversation trie and ranked search against plain versions."""

import random

import brute
import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from freshet.llm import k2treap, queries, recipes, tries

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(params=["small", "odd"])
def folder(request, odd):
    return SMALL if request.param == "small" else odd


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_exact_dedup", "op13_ranked_search"])
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    cursor = connection.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert by_text(cursor.fetchall()) == by_text(queries.QUERIES[name](spark, SMALL).select(*columns).collect())


def test_exact_dedup(spark, folder):
    got = queries.op12_exact_dedup(spark, folder).collect()
    assert by_text(got) == by_text(brute.exact_groups(brute.rows(folder, "documents", "doc_id", "text")))


def test_chunks_are_the_text():
    import re

    texts = ["", "a", "x" * 5000, "One two. " * 900, "\n" * 3000, "a.\U0001f600 " * 1500]
    for text in texts:
        parts = [m.group() for m in re.finditer(recipes.CUT, text)]
        assert "".join(parts) == text and all(0 < len(p) <= recipes.MOST for p in parts)


def test_hash_clashes_do_not_join_texts(spark, odd):
    """With a hash of three values most chunks clash; content still tells them apart."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = recipes.exact_groups(docs, identify=lambda c: F.xxhash64(c) % 3, rows_per_task=2, carry=("uid", "key"))
    assert got.columns[5:] == ["uid", "key"]
    wanted = brute.exact_groups(brute.rows(odd, "documents", "doc_id", "text"))
    assert by_text(r[:5] for r in got.collect()) == by_text(wanted)
    assert got.where("uid <> key").count() == 0


def test_hot_group_of_copies(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).otherwise("Same").alias("text"))
    got = recipes.exact_groups(docs, rows_per_task=50).collect()
    assert by_text(got) == by_text(brute.exact_groups((r.doc_id, r.text) for r in docs.collect()))


def odd_turns():
    """Null, tied, repeated and empty turns, copies, a long conversation, prefixes of one another."""
    rows = [
        (None, 1, "user", "left out"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "user", "tie b"), (1, 0, "user", "tie a"),
        (2, 5, "user", "a"), (2, 5, "user", "a"), (-7, 1, "user", "a"), (-5, 1, "user", "a"), (-5, 2, "assistant", "é"), (0, 1, "user", "x"),
        (2**62, 1, "user", "x"),
    ]
    rng = random.Random(5)
    for c in range(10, 200):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "äö"])) for t in range(rng.randrange(14))]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 360) for t in range(12)]
    rows += [(400, t, "user", f"long {t}") for t in range(700)]
    rows += [(c, t, "user", f"long {t}") for c in (405, 410) for t in range(c - 200)]
    return rows


@pytest.mark.parametrize("limit,most", [(tries.LIMIT, tries.RUN), (40, 7), (1, 3)])
def test_trie(spark, limit, most):
    rows = odd_turns()
    runs = tries.turn_runs(spark.createDataFrame(rows, TURNS).repartition(4, "text"), most=most)
    convs = tries.conversations(runs)
    plain = brute.rebuilt_conversations(rows)
    got = tries.prefix_trie(convs, tries.borrow_openings(runs), limit)
    assert by_text(got.collect()) == by_text(brute.prefix_nodes(plain))


def test_trie_with_many_equal_ids(spark, monkeypatch):
    """Ids of one group of copies hashed in pieces, tie for tie."""
    monkeypatch.setattr(tries, "PIECE", 3)
    rows = [(c, t, "user", str(t)) for c in range(0, 500, 5) for t in range(9)]
    runs = tries.turn_runs(spark.createDataFrame(rows, TURNS))
    got = tries.prefix_trie(tries.conversations(runs), runs)
    assert by_text(got.collect()) == by_text(brute.prefix_nodes({c: [("user", str(t)) for t in range(9)] for c in range(0, 500, 5)}))


def test_id_pieces_join_up():
    import pyarrow as pa

    columns = [pa.array([4] * 10), pa.array([1] * 7 + [2] * 3), pa.array([0] * 10), pa.array([9] * 10), pa.array(range(10))]
    batch = pa.RecordBatch.from_arrays(columns, names=["length", "x1", "x2", "bytes", "conv"])
    saved, tries.PIECE = tries.PIECE, 2
    try:
        pieces = list(tries._id_pieces([batch]))
    finally:
        tries.PIECE = saved
    assert [p[5] for p in pieces] == [2, 2, 2, 1, 2, 1]
    names = ["length", "x1", "x2", "bytes", "first", "copies", "ids"]
    made = list(tries._end_digests([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces)], names=names)]))
    assert [(m[4], m[5], m[6]) for m in made] == [(0, 7, brute.sha("0,1,2,3,4,5,6")), (7, 3, brute.sha("7,8,9"))]


def test_no_conversations(spark):
    runs = tries.turn_runs(spark.createDataFrame([], TURNS))
    assert tries.prefix_trie(tries.conversations(runs), tries.borrow_openings(runs)).collect() == []


ITEMS = [(1, "one two words"), (1, "one two words"), (None, "The END the end"), (3, None), (4, "ÉCOLE café \U0001f600"), (5, "zzz-absent"), (6, "same x y z don't 12")]


@pytest.mark.parametrize("k,entries", [(20, k2treap.GROUP_ENTRIES), (3, 4), (1000, k2treap.GROUP_ENTRIES)])
def test_search(spark, folder, monkeypatch, k, entries):
    monkeypatch.setattr(k2treap, "GROUP_ENTRIES", entries)
    items = ITEMS + (brute.rows(SMALL, "benchmark", "item_id", "text")[:10] if folder == SMALL else [])
    table = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, rank int, score int")
    found = k2treap.search(k2treap.build(spark.read.parquet(f"{folder}/documents.parquet")), table, k)
    wanted = brute.best_documents(brute.rows(folder, "documents", "doc_id", "text"), items, k)
    assert by_text(found.collect()) == by_text(wanted)


def test_search_over_many_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(40, "doc_id")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = k2treap.search(k2treap.build(docs), items, 5)
    folder = "/root/testdata/sf0.01"
    wanted = brute.best_documents(brute.rows(folder, "documents", "doc_id", "text"), brute.rows(folder, "benchmark", "item_id", "text"), 5)
    assert by_text(got.collect()) == by_text(wanted)


def test_search_of_nothing(spark, empty):
    none = spark.read.parquet(f"{empty}/documents.parquet")
    some = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert k2treap.search(k2treap.build(none), items).collect() == []
    assert k2treap.search(k2treap.build(some), items.limit(0)).collect() == []


def test_queries_read_whole_tables(spark):
    assert queries.op12_exact_dedup(spark, SMALL).count() == pq.read_table(f"{SMALL}/documents.parquet").num_rows
