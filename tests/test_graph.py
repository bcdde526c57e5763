import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import graph, lineage
from freshet.plans import refresh



def drawn(seed, nodes, edges, downwards=False):
    """A graph drawn at random; ``downwards``: from greater to lesser nodes only."""
    draw = random.Random(seed)
    pairs = {(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)}
    return sorted({(max(p), min(p)) for p in pairs if p[0] != p[1]} if downwards else pairs)


DRAWN = [drawn(seed, 12, 14, downwards=seed % 2 == 0) for seed in range(4)]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def nodes_of(spark, pairs, more=()):
    return spark.createDataFrame([(n,) for n in sorted({n for p in pairs for n in p} | set(more))], "node int")


def values(df):
    return sorted(r[0] for r in df.collect())


def reached(pairs, start):
    found, todo = {start}, [start]
    while todo:
        node = todo.pop()
        more = {b for a, b in pairs if a == node} - found
        found |= more
        todo += more
    return found


@pytest.mark.parametrize("pairs", [*DRAWN, [], [(4, 4)]])
def test_sources(spark, pairs):
    nodes = {n for p in pairs for n in p} | {70, 71}
    expected = sorted(nodes - {b for _, b in pairs})
    assert values(graph.sources(nodes_of(spark, pairs, nodes), edges_of(spark, pairs))) == expected


def test_sources_without(spark):
    pairs = DRAWN[0]
    tops = sorted({a for a, _ in pairs} - {b for _, b in pairs})
    rows = [(n, None if n % 2 else 30) for n in {n for p in pairs for n in p}]
    nodes = spark.createDataFrame(rows, "node int, interval int")
    lacking = [n for n in tops if n % 2]
    for given in (nodes, nodes.fillna(0, ["interval"])):
        assert values(graph.sources_without(given, edges_of(spark, pairs), "interval").select("node")) == lacking
    assert graph.drop_attributes(nodes, "interval", "unknown").columns == ["node"]


def test_children(spark):
    pairs = DRAWN[1]
    edges, nodes = edges_of(spark, pairs), nodes_of(spark, pairs)
    for node in {n for p in pairs for n in p}:
        assert values(graph.children(nodes, edges, node)) == sorted({b for a, b in pairs if a == node})
    with pytest.raises(LookupError):
        graph.children(nodes, edges, 77)


@pytest.mark.parametrize("pairs", DRAWN)
def test_reachable(spark, pairs):
    start = pairs[-1][0]
    starts = spark.createDataFrame([(start,)], "node int")
    assert values(graph.reachable(edges_of(spark, pairs), starts)) == sorted(reached(pairs, start))


def test_long_chain_is_compacted(spark):
    chain = [(i, i + 1) for i in range(12)]
    starts = spark.createDataFrame([(0,)], "node int")
    assert values(graph.reachable(edges_of(spark, chain), starts)) == list(range(13))
    found = graph.levels(nodes_of(spark, chain), edges_of(spark, chain))
    assert {r.node: r.level for r in found.collect()} == {i: 12 - i for i in range(13)}


def _cycles_by_hand(pairs):
    found = set()

    def walk(path):
        for src, dst in pairs:
            if src == path[-1]:
                if dst == path[0]:
                    found.add(tuple(path))
                elif dst > path[0] and dst not in path:
                    walk([*path, dst])

    for node in {n for p in pairs for n in p}:
        walk([node])
    return found


def test_cycles_of_random_graphs(spark):
    draw = random.Random(7)
    for _ in range(3):
        pairs = sorted({(draw.randrange(9), draw.randrange(9)) for _ in range(16)})
        edges, wanted = edges_of(spark, pairs), _cycles_by_hand(pairs)
        assert {tuple(r.cycle) for r in graph.cycles(edges).collect()} == wanted
        assert graph.is_acyclic(edges) == (not wanted)
    assert graph.is_acyclic(edges_of(spark, drawn(2, 12, 14, downwards=True)))


def test_levels_respect_every_edge(spark):
    draw = random.Random(3)
    pairs = sorted({tuple(sorted(draw.sample(range(30), 2), reverse=True)) for _ in range(60)})
    found = graph.levels(nodes_of(spark, pairs), edges_of(spark, pairs))
    level = {r.node: r.level for r in found.collect()}
    assert set(level) == {n for p in pairs for n in p}
    assert all(level[src] > level[dst] for src, dst in pairs)


def test_levels_with_a_cycle(spark):
    pairs = [(1, 2), (2, 3), (3, 2), (3, 4), (0, 1)]
    found = graph.levels(nodes_of(spark, pairs), edges_of(spark, pairs))
    level = {r.node: r.level for r in found.collect()}
    assert set(level) == {0, 1, 2, 3, 4}
    assert level[4] < level[3] and level[2] < level[1] < level[0]


def test_dependency_edges(spark):
    definitions = spark.createDataFrame(
        [
            ("sales.daily", "select day, sum(price) from raw.receipts group by day"),
            ("sales.monthly", 'select * from "sales"."daily" -- not ops.load'),
            ("ops.load", "select 1 from sales.daily d join sales.daily e on d.day = e.day"),
            ("ops.loop", "select * from ops.loop join sales.monthly"),
        ],
        "table_name string, query string",
    )
    edges = lineage.dependency_edges(definitions)
    assert sorted(tuple(r) for r in edges.collect()) == [
        ("ops.load", "sales.daily"),
        ("ops.loop", "ops.loop"),
        ("ops.loop", "sales.monthly"),
        ("sales.monthly", "sales.daily"),
    ]
    assert values(lineage.readers_of(definitions, "sales.daily").select("table_name")) == ["ops.load", "sales.monthly"]

    catalog = definitions.withColumn("force", F.lit(None).cast("int"))
    starts = spark.createDataFrame([("sales.monthly",), ("no.such",)], "node string")
    forced = refresh.force_propagation(catalog, graph.reachable(edges, starts))
    assert values(forced.where("force = 1").select("table_name")) == ["sales.daily", "sales.monthly"]


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_random_graphs(spark, seed):
    pairs = drawn(seed, 14, 20 + 4 * seed) + [(20, 20), (21, 20)]
    there = {n: {m for a, b in pairs if a == n for m in reached(pairs, b)} for n in {x for p in pairs for x in p}}
    wanted = {n: min(m for m in far if n in there[m]) for n, far in there.items() if n in far}
    got = {r.node: r.component for r in graph.strong_components(edges_of(spark, pairs)).collect()}
    assert got == wanted
    levels = {r.node: r for r in graph.condensed_levels(nodes_of(spark, pairs, [30]), edges_of(spark, pairs)).collect()}
    assert set(levels) == set(there) | {30} and levels[30].level == 0
    for a, b in pairs:
        same = levels[a].component == levels[b].component
        assert same or levels[a].level > levels[b].level
    assert all(r.size == sum(x.component == r.component for x in levels.values()) for r in levels.values())


def test_strong_components_of_no_edges(spark):
    assert graph.strong_components(edges_of(spark, [])).isEmpty()


def test_paths_stay_in_a_component(spark, monkeypatch):
    """Cycles far apart on a dense graph without others: paths between them are not walked."""
    pairs = [(a, b) for a in range(30) for b in range(a)] + [(0, 1), (28, 29), (40, 40)]
    staged = []

    def watched(df, counted=None, stage=graph.stage):
        stored, n = stage(df, counted)
        if "path" in stored.columns:
            staged.append(stored.count())
        return stored, n

    monkeypatch.setattr(graph, "stage", watched)
    assert sorted(tuple(r.cycle) for r in graph.cycles(edges_of(spark, pairs)).collect()) == [(0, 1), (28, 29), (40,)]
    assert max(staged) <= 2


def test_large_tables_are_not_sent_to_every_node(spark):
    pairs = spark.range(60_000).select(F.concat(F.lit("s.t"), "id").alias("src"), F.concat(F.lit("s.t"), (F.col("id") / 2).cast("long")).alias("dst"))
    large, n = graph.stage(pairs)
    small, _ = graph.stage(pairs.limit(5))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert n == 60_000
    assert "Broadcast" not in plan(large.join(large.select("src").distinct(), "src", "left_semi"))
    assert "BroadcastHashJoin" in plan(large.join(small.select("src"), "src", "left_semi"))
