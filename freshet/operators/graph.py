"""The dependency graph: ``nodes(node, ...)`` and ``edges(src, dst)``; src reads dst.

Loops run one round per step of depth.  A round is one job from the frontier; its
result is staged in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.skew import HotKeys, find_hot_keys, spread_join
from freshet.session import sized
from freshet.session import stage_sized as stage

COMPACT_EVERY = 8


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing reads; a node that reads itself is no source."""
    # Many edges share a hot target: reduce them to distinct targets before the join.
    targets = edges.select(F.col("dst").alias("node")).distinct()
    return nodes.join(targets, "node", "left_anti")


def sources_without(nodes: DataFrame, edges: DataFrame, attribute: str) -> DataFrame:
    """Sources whose attribute is missing; 0 and an empty text count as missing."""
    value = F.col(attribute).cast("string")
    return sources(nodes.where(value.isNull() | value.isin("", "0", "0.0", "false")), edges)


def children(nodes: DataFrame, edges: DataFrame, node) -> DataFrame:
    """What one node reads directly; an unknown node is an error."""
    if nodes.where(F.col("node") == node).isEmpty():
        raise LookupError(f"no node {node}")
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def drop_attributes(nodes: DataFrame, *attributes: str) -> DataFrame:
    return nodes.drop(*attributes)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def read_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct nodes that ``nodes`` read."""
    # What one node reads is bounded by its text; a node read by many collapses
    # before the shuffle of the distinct.
    ends = nodes.select(F.col("node").alias("src"))
    return edges.join(ends, "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def readers(edges: DataFrame, nodes: DataFrame, hot: HotKeys) -> DataFrame:
    """The distinct nodes that read ``nodes``; ``hot`` are the targets of many edges."""
    ends = nodes.select(F.col("node").alias("dst"))
    hit = spread_join(edges, ends, "dst", "left_semi", ["src"], hot)
    return hit.select(F.col("src").alias("node")).distinct()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes that can be reached from ``starts(node)``, starts included."""
    edges, _ = stage(edges.select("src", "dst"))
    frontier, n = stage(starts.select("node").distinct())
    seen, n_seen = [frontier], n
    while n:
        step = read_by(edges, frontier).join(sized(union_all(seen), n_seen), "node", "left_anti")
        frontier, n = stage(step)
        seen.append(frontier)
        n_seen += n
        if len(seen) == COMPACT_EVERY:
            seen = [stage(union_all(seen))[0]]
    return union_all(seen)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges on cycles and on paths from cycle to cycle; empty if there is no cycle.

    Edges from nodes nothing reads, and to nodes that read nothing, are peeled off
    from both sides until none is left to peel.
    """
    core, n = stage(edges.select("src", "dst").distinct())
    hot = find_hot_keys(core, "dst")
    while n:
        read = core.select(F.col("dst").alias("src")).distinct()
        reading = core.select(F.col("src").alias("dst")).distinct()
        inner = core.join(read, "src", "left_semi")
        inner = spread_join(inner, reading, "dst", "left_semi", ["src"], hot)
        core, left = stage(inner.select("src", "dst"))
        if left == n:
            break
        n = left
    return core


def is_acyclic(edges: DataFrame) -> bool:
    return cyclic_core(edges).isEmpty()


def cycles(edges: DataFrame) -> DataFrame:
    """Every elementary cycle once, as ``(cycle, length)`` with the least node first.

    Paths grow from each node of a strong component through greater nodes of the same one,
    so each cycle is met from its least node alone, and paths that no cycle closes do not leave it.
    """
    core, components = _components(edges)
    of_src = components.select(F.col("node").alias("src"), F.col("component").alias("_src"))
    of_dst = components.select(F.col("node").alias("dst"), F.col("component").alias("_dst"))
    inside = spread_join(core.join(of_src, "src"), of_dst, "dst", "inner", ["src"], find_hot_keys(core, "dst"))
    core, _ = stage(inside.where("_src = _dst").select("src", "dst"))
    found = [core.where("src = dst").select(F.array("src").alias("cycle"))]
    steps = core.where("src <> dst")
    paths = steps.where("src < dst").select(F.array("src", "dst").alias("path"))
    while True:
        first, last, to = F.element_at("path", 1), F.element_at("path", -1), F.col("dst")
        closes = (to == first).alias("closes")
        grown = (
            paths.withColumn("src", last)
            .join(steps, "src")
            .where((to == first) | ((to > first) & ~F.array_contains("path", to)))
            .select(
                F.when(to == first, F.col("path")).otherwise(F.array_append("path", to)).alias("path"),
                closes,
            )
        )
        grown, n_open = stage(grown, counted=~F.col("closes"))
        found.append(grown.where("closes").select(F.col("path").alias("cycle")))
        if not n_open:
            break
        paths = grown.where("NOT closes").select("path")
    return union_all(found).withColumn("length", F.size("cycle").cast("int"))


def _least_reaching(edges: DataFrame) -> DataFrame:
    """Stored ``(node, colour)``: the least node from which each node of ``edges`` is reached, itself included.

    A round hands on only what has become less, so rounds follow the longest of the shortest paths.
    """
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    colours, n = stage(ends.distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("_moved")))
    while n:
        moved = colours.where("_moved").select(F.col("node").alias("src"), F.col("colour").alias("_offer"))
        # What a node reads is bounded by its text; offers to a hot node collapse before the shuffle.
        offers = edges.join(moved, "src").groupBy(F.col("dst").alias("node")).agg(F.min("_offer").alias("_offer"))
        lower = F.coalesce(F.col("_offer") < F.col("colour"), F.lit(False))
        colours, n = stage(
            colours.join(offers, "node", "left").select("node", F.least("colour", "_offer").alias("colour"), lower.alias("_moved")),
            counted=F.col("_moved"),
        )
    return colours.drop("_moved")


def _mutual_groups(edges: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``(node, group)`` of nodes that read each other, directly or through others that do, and how many."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs, n = stage(edges.where("src <> dst").join(back, ["src", "dst"], "left_semi").select("src", "dst"))
    groups = _least_reaching(pairs) if n else pairs.select(F.col("src").alias("node"), F.col("dst").alias("colour"))
    return groups.withColumnRenamed("colour", "group"), n


def _merged(edges: DataFrame, groups: DataFrame, hot: HotKeys) -> DataFrame:
    """The edges between groups, a node in none standing for itself; none from a group to itself."""
    of_src = groups.select(F.col("node").alias("src"), F.col("group").alias("_src"))
    of_dst = groups.select(F.col("node").alias("dst"), F.col("group").alias("_dst"))
    named = spread_join(edges.join(of_src, "src", "left"), of_dst, "dst", "left", ["src"], hot)
    named = named.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    return named.where("src <> dst").distinct()


def _components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cyclic core of ``edges``, and the components of ``strong_components``; both stored."""
    core = cyclic_core(edges)
    loops = core.where("src = dst").select(F.col("src").alias("component"), F.lit(True).alias("_loop"))
    groups, n_mutual = _mutual_groups(core)
    rest = cyclic_core(_merged(core, groups, find_hot_keys(core, "dst"))) if n_mutual else core
    found = []
    while not rest.isEmpty():
        hot = find_hot_keys(rest, "dst")
        colours = _least_reaching(rest)
        of_src = colours.select(F.col("node").alias("src"), F.col("colour").alias("_src"))
        of_dst = colours.select(F.col("node").alias("dst"), F.col("colour").alias("_dst"))
        inner = spread_join(rest.join(of_src, "src"), of_dst, "dst", "inner", ["src"], hot)
        inner, _ = stage(inner.where("_src = _dst").select("src", "dst"))
        frontier, n = stage(colours.where("node = colour").select("node"))
        seen, n_seen = [frontier], n
        while n:
            frontier, n = stage(readers(inner, frontier, hot).join(sized(union_all(seen), n_seen), "node", "left_anti"))
            seen.append(frontier)
            n_seen += n
            if len(seen) == COMPACT_EVERY:
                seen = [stage(union_all(seen))[0]]
        members, _ = stage(union_all(seen).join(colours, "node").withColumnRenamed("colour", "component"))
        found.append(members)
        done = members.select("node")
        left = inner.join(done.withColumnRenamed("node", "src"), "src", "left_anti")
        left = spread_join(left, done.withColumnRenamed("node", "dst"), "dst", "left_anti", ["src"], hot)
        rest = cyclic_core(left)
    none = core.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    every, _ = stage(union_all([none, *(members.select("node", "component") for members in found)]))
    if n_mutual:
        # A group is named after its least node, so a component of groups is named after its least node too.
        members = spread_join(groups, every.withColumnRenamed("node", "group"), "group", "left", ["node"], find_hot_keys(groups, "group"))
        members = members.select("node", F.coalesce("component", "group").alias("component"))
        every, _ = stage(members.unionByName(every.join(groups.select("node"), "node", "left_anti")))
        alone = loops.select(F.col("component").alias("node"), "component").join(every.select("node"), "node", "left_anti")
        every, _ = stage(every.unionByName(alone.select("node", "component")))
    # A node between two cycles has been found as a component of its own.
    cyclic = (
        every.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        .join(loops, "component", "left").where("_n > 1 or _loop").select("component")
    )
    whole = spread_join(every, cyclic, "component", "left_semi", ["node"], find_hot_keys(every, "component"))
    return core, stage(whole.select("node", "component"))[0]


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of each node on a cycle; a component goes by its least node.

    Nodes that read each other are merged first and what is then on no cycle peeled off.  The
    rest by forward-backward colouring: each node takes the least node that reaches it as its colour.
    The nodes of a colour that reach the node it is named after are one component.  Edges
    between colours, and those of components found, go; what is left of the cyclic core is
    coloured anew.  Every step is a join over edges, so memory does not grow with the number
    of cycles.  A node that reads itself and is on no other cycle is a component of one.
    """
    return _components(edges)[1]


def condensed_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component, size, level)`` of ``nodes``, levels counted from component to component.

    A node on no cycle is a component of one.  Nodes of one component have one level; none
    of the edges between components is left out.
    """
    named = nodes.select("node").distinct().join(strong_components(edges), "node", "left")
    named, _ = stage(named.withColumn("component", F.coalesce("component", "node")))
    links, _ = stage(edges.select("src", "dst").distinct())
    hot = find_hot_keys(links, "dst")
    of_src = named.select(F.col("node").alias("src"), F.col("component").alias("_src"))
    of_dst = named.select(F.col("node").alias("dst"), F.col("component").alias("_dst"))
    between = spread_join(links.join(of_src, "src"), of_dst, "dst", "inner", ["src"], hot).where("_src <> _dst")
    between = between.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    steps = levels(sizes.select(F.col("component").alias("node")), between).withColumnRenamed("node", "component")
    every, _ = stage(sizes.join(steps, "component"))
    hot = find_hot_keys(named, "component")
    return spread_join(named, every, "component", "inner", ["node"], hot).select("node", "component", "size", "level")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)``: the length of the longest walk down from each of ``nodes``.

    Only edges between ``nodes`` count.  Level 0 reads none of the others, and
    nodes of one level do not read each other.  Where edges form cycles, those of
    the cyclic core that lead from a lesser to a greater name are left out.
    """
    nodes, n_before = stage(nodes.select("node").distinct())
    links = edges.where("src <> dst").select("src", "dst").distinct()
    links, n = stage(links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi"))
    hot = find_hot_keys(links, "dst")
    inside = nodes.withColumnRenamed("node", "dst")
    links, _ = stage(spread_join(links, inside, "dst", "left_semi", ["src"], hot).select("src", "dst"))
    # Round by round: the nodes where walks of that length start.
    starts, level, n = nodes, 0, n_before
    reached = [nodes.withColumn("level", F.lit(0))]
    while n:
        level += 1
        starts, n = stage(readers(links, starts, hot))
        # Longer walks start at no other nodes than shorter ones do; if at as many,
        # walks of any length start there.
        if n and n == n_before:
            core = cyclic_core(links).where("src < dst")
            return levels(nodes, links.join(core, ["src", "dst"], "left_anti"))
        n_before = n
        reached.append(starts.withColumn("level", F.lit(level)))
        if len(reached) == COMPACT_EVERY:
            reached = [stage(_deepest(reached))[0]]
    return _deepest(reached)


def _deepest(reached: list[DataFrame]) -> DataFrame:
    return union_all(reached).groupBy("node").agg(F.max("level").alias("level"))
