"""The prefix trie of all conversations, built as a burst trie.

A turn's id is the MD5 of role and text; a conversation is rows of at most ``RUN`` turns with
their ids in order, so none has to fit into one row.  Equal conversations are found by a digest
that is summed up from their turns, and enter the trie once, with their number.

At first one container hangs under the root and holds all conversations.  Containers of more
than ``LIMIT`` turns burst: their conversations go on by their next turn ids into containers
under new heads, by 1, 2, 4 ... turns a round, so that the rounds are few also where many
conversations share a long opening.  What is left is dealt to tasks, sorted, and swept into
nodes; the suffix of a single conversation needs no container, its rows become nodes where
they are.  Sums over the subtrees of heads come from sums over their conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import text_of
from freshet.operators.graph import union_all
from freshet.session import stage

WIDTH, RUN, LIMIT, PIECE = 16, 1024, 100_000, 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_RUNS = "conv long, no long, n int, ids binary, sizes binary"
_NODES = (
    "container boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_KEY = ["at", "k1", "k2"]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batches(rows: Iterator[tuple], ddl: str, many: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of rows."""
    schema, held = _arrow(ddl), []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == many:
            yield packed()
            held = []
    if held:
        yield packed()


def _cut_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    no = 0
    for batch in batches:
        convs, sizes = batch.column("conv").to_numpy(), batch.column("size").to_numpy().astype("<i8")
        ids = batch.column("id").to_pylist()
        starts = np.flatnonzero(np.concatenate(([True], convs[1:] != convs[:-1]))) if len(convs) else []
        for first, end in zip(starts, [*starts[1:], len(convs)], strict=True):
            for at in range(first, end, most):
                to = min(at + most, end)
                yield int(convs[at]), no, to - at, b"".join(ids[at:to]), sizes[at:to].tobytes()
                no += 1


def turn_runs(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = RUN
) -> DataFrame:
    """``(conv, start, n, ids, sizes)``: the turns of each conversation in order, some in a row.

    Turns go by ``turn``, null first, ties by role and text; a null role or text counts as
    empty, repeated rows are turns of their own, rows without a conversation id are left out.
    A range sort numbers them, so a very long conversation is cut over many tasks.
    """
    own = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"),
        F.monotonically_increasing_id().alias("uid"),
    )
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    own = own.withColumn("id", F.unhex(F.md5(whole.cast("binary")))).withColumn("size", F.octet_length("text"))
    in_order = own.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", "uid").select("conv", "id", "size")
    runs = in_order.mapInArrow(lambda batches: _batches(_cut_runs(batches, most), _RUNS, 500), _RUNS)
    earlier = Window.partitionBy("conv").orderBy("task", "no").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("task", F.spark_partition_id()).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return stage(runs.select("conv", "start", "n", "ids", "sizes"))[0]


def conversations(runs: DataFrame) -> DataFrame:
    """``(conv, length)``"""
    return runs.groupBy("conv").agg(F.sum("n").alias("length"))


def _part(first, n) -> list:
    """Columns of a run without its first turns, ``n`` turns long."""
    return [
        F.col("ids").substr(F.lit(1) + first * WIDTH, n * WIDTH).alias("ids"),
        F.col("sizes").substr(F.lit(1) + first * 8, n * 8).alias("sizes"),
    ]


def borrow_openings(runs: DataFrame, every: int = 5, below: int = 9) -> DataFrame:
    """Conversation c opens with the first h turns of c - c % every, then goes on after its own first h.

    h is the unsigned crc32 of the decimal c modulo ``below``.  Where that conversation is absent or
    shorter there is nothing or less to borrow.  ``%`` goes towards zero, as in SQL.
    """
    lengths = conversations(runs)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % below).cast("int")
    plan = lengths.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("from"))
    lent = lengths.select(F.col("conv").alias("from"), F.col("length").alias("has"))
    plan = plan.join(lent, "from", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    openings = runs.where((F.col("start") < below - 1) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "from")
    n = F.least("n", F.col("h") - F.col("start")).cast("int")
    borrowed = plan.join(openings, "from").where(F.col("start") < F.col("h"))
    borrowed = borrowed.select("conv", "start", n.alias("n"), *_part(F.lit(0), n))
    skip = F.greatest(F.col("h") - F.col("start"), F.lit(0)).cast("int")
    own = runs.join(plan, "conv").where(F.col("start") + F.col("n") > F.col("h"))
    own = own.select(
        "conv", (F.col("start") + skip - F.col("h") + F.col("taken")).alias("start"), (F.col("n") - skip).alias("n"),
        *_part(skip, F.col("n") - skip),
    )
    return borrowed.unionByName(own)


def _mix(x: np.ndarray) -> np.ndarray:
    # Multipliers of the splitmix64 finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_hashes(ids: bytes, start: int) -> np.ndarray:
    """Two columns of 64 bits per turn, from its id and depth; a prefix has the xor of its turns."""
    halves = np.frombuffer(ids, "<u8").reshape(-1, 2)
    depths = np.arange(start + 1, start + 1 + len(halves), dtype=np.uint64)
    return np.stack([_mix(halves[:, i] ^ _mix(depths * np.uint64(2) + np.uint64(i))) for i in (0, 1)], axis=1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for start, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("start", "ids", "sizes")), strict=True):
            x1, x2 = np.bitwise_xor.reduce(turn_hashes(ids, start)).view(np.int64).tolist()
            made.append((x1, x2, int(np.frombuffer(sizes, "<i8").sum())))
        columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * 3
        names = [*batch.schema.names, "x1", "x2", "bytes"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def _summed(runs: DataFrame) -> DataFrame:
    """Each run with xor and bytes of its own turns, and of all turns before it (``p1, p2, before``)."""
    runs = runs.select("conv", F.col("start").cast("long").alias("start"), F.col("n").cast("int").alias("n"), "ids", "sizes")
    runs = runs.mapInArrow(_sums, "conv long, start long, n int, ids binary, sizes binary, x1 long, x2 long, bytes long")
    earlier = Window.partitionBy("conv").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    for total, of, value in (("p1", F.bit_xor, "x1"), ("p2", F.bit_xor, "x2"), ("before", F.sum, "bytes")):
        runs = runs.withColumn(total, F.coalesce(of(value).over(earlier), F.lit(0)))
    return stage(runs)[0]


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations in order of their digest become lists of ids, cut where a task or list ends."""
    digest, ids = None, []
    for batch in batches:
        for *one, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one != digest or len(ids) == PIECE:
                if ids:
                    yield *digest, ids[0], len(ids), ",".join(map(str, ids))
                digest, ids = one, []
            ids.append(conv)
    if ids:
        yield *digest, ids[0], len(ids), ",".join(map(str, ids))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Lists in order become one hash per digest; a task holds a list at a time, however many there are."""
    digest = None
    for batch in batches:
        for *one, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one == digest:
                total += n
                sha.update(b",")
            else:
                if digest:
                    yield *digest, rep, total, sha.hexdigest()
                digest, rep, total, sha = one, first, n, hashlib.sha256()
            sha.update(ids.encode())
    if digest:
        yield *digest, rep, total, sha.hexdigest()


def distinct_sequences(convs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(length, x1, x2, bytes, rep, copies, ends)``: each distinct conversation, its least id, all its ids hashed."""
    digests = runs.groupBy("conv").agg(
        F.sum("n").alias("length"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes")
    )
    digest = ["length", "x1", "x2", "bytes"]
    sequences = convs.select("conv").join(digests, "conv", "left").select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in digest], "conv")
    kept = ", ".join(f"{c} long" for c in digest)
    listed = f"{kept}, first long, copies long, ids string"
    pieces = sequences.orderBy(*digest, "conv").mapInArrow(lambda b: _batches(_id_pieces(b), listed, 100), listed)
    pieces = pieces.repartition(*digest).sortWithinPartitions(*digest, "first")
    hashed = f"{kept}, rep long, copies long, ends string"
    return stage(pieces.mapInArrow(lambda b: _batches(_end_digests(b), hashed), hashed))[0]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per turn between two depths: digest and bytes of the prefix before and with it."""
    for batch in batches:
        made = []
        columns = ("rep", "copies", "at", "goal", "start", "ids", "sizes", "p1", "p2", "before")
        for rep, copies, at, goal, start, ids, sizes, p1, p2, before in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            prefix = np.concatenate((np.array([[p1, p2]], np.int64).view(np.uint64), turn_hashes(ids, start)))
            prefix = np.bitwise_xor.accumulate(prefix).view(np.int64)
            sizes = np.frombuffer(sizes, "<i8")
            behind = before + np.concatenate(([0], np.cumsum(sizes)))
            depths = np.arange(start + 1, start + 1 + len(sizes))
            own = np.flatnonzero((depths > at) & (depths <= goal))
            made.append(np.column_stack((
                np.full(len(own), rep), np.full(len(own), copies), depths[own], prefix[own + 1], prefix[own], behind[own], sizes[own], depths[own] == goal
            )))
        table = np.concatenate(made) if made else np.empty((0, 10), np.int64)
        names = ["rep", "copies", "depth", "k1", "k2", "o1", "o2", "before", "size", "goal"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=names)


def burst(sequences: DataFrame, runs: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Where each sequence ends up: its container's head ``(at, k1, k2)``; and the paths there, by rounds."""
    zero = F.lit(0).cast("long")
    places = sequences.select("rep", "length", "copies", "bytes", "ends", zero.alias("at"), zero.alias("k1"), zero.alias("k2"), zero.alias("headed"))
    # As stored rows: joins on literals would become joins without a key.
    (places, _), paths, step = stage(places), [], 1
    while True:
        inside = places.where("length > at").groupBy(*_KEY).agg(F.sum(F.col("length") - F.col("at")).alias("left"), F.count(F.lit(1)).alias("n"))
        large, n = stage(inside.where((F.col("left") > limit) & (F.col("n") > 1)).select(*_KEY))
        if not n:
            return places, paths
        going = places.where("length > at").join(large, _KEY).withColumn("goal", F.least("length", F.col("at") + step))
        rows = going.drop("k1", "k2", "bytes").join(runs, F.col("rep") == F.col("conv"))
        rows = rows.where((F.col("start") < F.col("goal")) & (F.col("start") + F.col("n") > F.col("at")))
        walked = rows.mapInArrow(_paths, ", ".join(f"{c} long" for c in "rep copies depth k1 k2 o1 o2 before size goal".split()))
        walked, _ = stage(walked)
        paths.append(walked)
        reached = walked.where("goal = 1").select(
            "rep", F.struct(F.col("depth").alias("at"), "k1", "k2", (F.col("before") + F.col("size")).alias("headed")).alias("now")
        )
        now = [F.coalesce(f"now.{c}", c).alias(c) for c in (*_KEY, "headed")]
        places, _ = stage(places.join(reached, "rep", "left").select("rep", "length", "copies", "bytes", "ends", *now))
        step *= 2


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The nodes of suffixes that are alone under their head."""
    columns = ("rep", "copies", "length", "bytes", "ends", "at", "head_conv", "start", "sizes", "before")
    for batch in batches:
        for rep, copies, length, total, ends, at, head, start, sizes, before in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            for depth, size in enumerate(np.frombuffer(sizes, "<i8").tolist(), start + 1):
                if depth > at:
                    saved = (copies - 1) * (total - before)
                    if depth == at + 1:
                        yield True, rep, at, None, None, 1, 1, saved, None
                    last = depth == length
                    yield False, rep, depth, rep if depth > at + 1 else head, copies, int(not last), 1, saved, ends if last else NO_ENDS
                before += size


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows become containers, one at a time: ``(at, head_conv, [(ids, sizes, rep, copies, ends)])``."""
    key, held = None, {}
    columns = ("at", "k1", "k2", "head_conv", "rep", "copies", "ends", "start", "ids", "sizes")
    for batch in batches:
        for at, k1, k2, head, rep, copies, ends, start, ids, sizes in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if (at, k1, k2) != key:
                if held:
                    yield key[0], over, list(held.values())
                key, over, held = (at, k1, k2), head, {}
            skip = max(0, at - start)
            one = held.setdefault(rep, [b"", b"", rep, copies, ends])
            one[0] += ids[skip * WIDTH :]
            one[1] += sizes[skip * 8 :]
    if held:
        yield key[0], over, list(held.values())


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // WIDTH


class _Open:
    """A node whose subtree is still being swept."""

    def __init__(self, size: int):
        self.size, self.conv, self.copies, self.leaves, self.saved, self.ends, self.children = size, None, 0, 0, 0, NO_ENDS, []

    def take(self, conv: int, copies: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.copies += copies


def _sweep(at: int, head: int, sequences: list) -> Iterator[tuple]:
    """Nodes of one container, children before their parents, and a row for the container itself."""
    sequences.sort(key=lambda one: one[0])
    path, ids_before = [_Open(0)], b""

    def close() -> Iterator[tuple]:
        node = path.pop()
        node.saved += (node.copies - 1) * node.size
        node.leaves = node.leaves or 1
        depth = at + len(path)
        for child in node.children:
            yield (*child[:3], node.conv, *child[4:])
        above = path[-1]
        above.take(node.conv, node.copies)
        above.leaves += node.leaves
        above.saved += node.saved
        above.children.append((False, node.conv, depth, None, node.copies, len(node.children), node.leaves, node.saved, node.ends))

    for ids, sizes, rep, copies, ends in sequences:
        shared = shared_turns(ids_before, ids)
        while len(path) > shared + 1:
            yield from close()
        path += [_Open(size) for size in np.frombuffer(sizes, "<i8")[shared:].tolist()]
        path[-1].take(rep, copies)
        path[-1].ends = ends
        ids_before = ids
    while len(path) > 1:
        yield from close()
    top = path[0]
    for child in top.children:
        yield (*child[:3], head, *child[4:])
    yield True, top.conv, at, None, None, len(top.children), top.leaves, top.saved, None


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches((row for one in _containers(batches) for row in _sweep(*one)), _NODES)


def prefix_trie(convs: DataFrame, runs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per distinct prefix of the conversations ``convs(conv)`` with turns ``runs``, the root included.

    ``conv_id`` is the least of those that start so, ``depth`` the turns of the prefix,
    ``parent_conv_id`` its parent's ``conv_id`` (null at the root), ``n_convs`` how many start so,
    ``n_children`` and ``n_leaves`` count longer prefixes by one turn, and those without longer ones
    (itself, if it has none), ``saved_tokens`` sums (n_convs - 1) times the bytes of the last text
    over the subtree, ``ends_sha256`` hashes the ids of those that end here, in numerical order.
    Conversations without turns end at the root.  Without conversations there are no rows.
    """
    runs = _summed(runs)
    sequences = distinct_sequences(convs, runs)
    known = sequences.agg(F.min("rep").alias("conv"), F.sum("copies").alias("n")).first()
    if known.conv is None:
        return convs.sparkSession.createDataFrame([], _NODES).drop("container")
    places, paths = burst(sequences.where("length > 0"), runs, limit)

    heads = places.groupBy(*_KEY).agg(F.count_if(F.col("length") > F.col("at")).alias("n"), F.min("rep").alias("head_conv"))
    heads = heads.where("n > 0").withColumn("head_conv", F.when(F.col("at") == 0, F.lit(known.conv)).otherwise(F.col("head_conv")))
    held = places.where("length > at").join(heads.withColumnRenamed("n", "others"), _KEY)
    held = held.join(runs.withColumnRenamed("bytes", "_bytes"), F.col("rep") == F.col("conv")).where(F.col("start") + F.col("n") > F.col("at"))
    alone = held.where("others = 1").select("rep", "copies", "length", "bytes", "ends", "at", "head_conv", "start", "sizes", "before")
    alone = alone.mapInArrow(lambda b: _batches(_chains(b), _NODES), _NODES)
    shared = held.where("others > 1").select(*_KEY, "head_conv", "rep", "copies", "ends", "start", "ids", "sizes")
    shared = shared.repartition(*_KEY).sortWithinPartitions(*_KEY, "rep", "start").mapInArrow(_swept, _NODES)
    swept, _ = stage(alone.unionByName(shared))

    nodes = swept.where("NOT container")
    containers = swept.where("container").select(
        F.col("conv_id").alias("rep"), F.col("n_children").alias("below"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
    )
    return union_all([nodes, *_heads(places, paths, containers, sequences, known.conv, known.n)]).drop("container")


def _heads(places: DataFrame, paths: list[DataFrame], containers: DataFrame, sequences: DataFrame, least: int, n: int) -> list[DataFrame]:
    """The root, and the heads of burst containers.

    With P the bytes before a head, a sequence c adds to each head over it: copies(c) times the
    bytes of its path, less the bytes of the heads that c is the least under, plus what the
    container of which c is the least saves.  From that comes what the head saves.
    """
    spark = places.sparkSession
    names = [c.split()[0] for c in _NODES.split(", ")]
    kids = places.join(containers, "rep").select(*_KEY, "below")
    if paths:
        walked = union_all(paths)
        heads, _ = stage(
            walked.groupBy("depth", "k1", "k2").agg(
                F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"),
                *[F.min(c).alias(c) for c in ("o1", "o2", "before")],
            )
        )
        over = [(F.col("depth") - 1).alias("at"), F.col("o1").alias("k1"), F.col("o2").alias("k2")]
        kids = kids.unionByName(heads.select(*over, F.lit(1).cast("long").alias("below")))
        owned = heads.groupBy(F.col("conv_id").alias("rep")).agg(F.min_by("before", "depth").alias("unowned"))
    else:
        owned = places.select("rep", F.lit(0).cast("long").alias("unowned")).limit(0)
    kids, _ = stage(kids.groupBy(*_KEY).agg(F.sum("below").alias("n_children")))

    # A sequence that ends at a head nothing hangs under is a leaf.
    shares = places.join(containers, "rep", "left").join(owned, "rep", "left").join(kids, _KEY, "left")
    own = F.coalesce(F.col("headed") - F.col("unowned"), F.lit(0))
    ends_here = (F.col("length") == F.col("at")) & F.col("n_children").isNull()
    shares, n_shares = stage(
        shares.select(
            "rep",
            (F.col("copies") * F.col("headed") - own + F.coalesce("saved", F.lit(0))).alias("share"),
            F.coalesce("leaves", ends_here.cast("long")).alias("leaves"),
            (own - F.col("headed")).alias("rest"),
        )
    )
    total = shares.agg(F.sum("share").alias("saved"), F.sum("leaves").alias("leaves")).first()
    ends = sequences.where("length = 0").select("ends").first()
    below = kids.where("at = 0").select("n_children").first()
    root = (False, least, 0, None, n, below[0] if below else 0, total.leaves if n_shares else 1, total.saved or 0, ends[0] if ends else NO_ENDS)
    made = [spark.createDataFrame([root], _NODES)]
    if paths:
        sums = walked.join(shares, "rep").groupBy("depth", "k1", "k2").agg(F.sum("share").alias("share"), F.sum("leaves").alias("n_leaves"))
        parents = heads.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("conv_id").alias("parent_conv_id"))
        ending = places.where("length = at").select(F.col("at").alias("depth"), "k1", "k2", F.col("ends").alias("ends_sha256"))
        rest = shares.select(F.col("rep").alias("conv_id"), "rest")
        done = (
            heads.join(sums, ["depth", "k1", "k2"])
            .join(rest, "conv_id")
            .join(kids.withColumnRenamed("at", "depth"), ["depth", "k1", "k2"], "left")
            .join(ending, ["depth", "k1", "k2"], "left")
            .join(parents, ["depth", "o1", "o2"], "left")
        )
        made.append(
            done.withColumns(
                {
                    "container": F.lit(False),
                    "parent_conv_id": F.coalesce("parent_conv_id", F.lit(least)),
                    "n_children": F.coalesce("n_children", F.lit(0)),
                    "saved_tokens": F.col("share") + F.col("rest") - (F.col("n_convs") - 1) * F.col("before"),
                    "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS)),
                }
            ).select(*names)
        )
    return made
