"""The trie of conversations' common beginnings, and sums over its subtrees by tree contraction.

A node is a distinct sequence of first turns. Its name is made of sums over hashes of
(depth, role, text), so that the beginnings of a conversation of any length are found by running
sums; no text is shuffled. The sums over subtrees take a number of rounds of joins that grows
with the logarithm of the number of nodes: each round cuts out unary nodes of which no two are
neighbours (compress) and adds all leaves to their parents (rake). A node that was cut out is
worth what it was worth itself plus its child, so at the end these are followed, doubling the
step each time, until all lead to raked nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.places import numbered, starts_of_runs

FAMILY = 20  # conversations c share the beginning of conversation c - c % FAMILY
SHARED = 4  # the first crc32(c) % SHARED turns
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
HALVES = ("s1", "s2", "s3", "s4")


def _halves(depth: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at its depth, whose sums don't overflow."""
    a, b = F.xxhash64(depth, "d1", "d2"), F.xxhash64("d2", depth, "d1")
    low = F.lit(0xFFFFFFFF)
    return [x.alias(n) for x, n in zip((a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)), HALVES)]


def _name(depth: Column, sums: Sequence[Column]) -> Column:
    depth = depth.cast("long")
    sums = [x.cast("long") for x in sums]
    return F.concat(F.lpad(F.hex(F.xxhash64(depth, *sums)), 16, "0"), F.lpad(F.hex(F.xxhash64(*reversed(sums), depth)), 16, "0"))


def _root() -> Column:
    return _name(F.lit(0), [F.lit(0)] * 4)


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after rebuilding: conv_id, part, depth, d1, d2, n_words, length; and conv_id, length.

    Turns are in the order of ``turn``, null first, and within a turn in that of a hash of role
    and text. Conversation c begins with the first h turns of conversation c - c % family (all,
    if it has fewer; none, if there is no such conversation), h being crc32 of decimal c, modulo
    ``shared``; its own turns after its first h follow. A null role or text is empty. Rows
    without a conv_id belong to no conversation and are left out. d1 and d2 are hashes of (role,
    text). Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(conversations[x].cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(text, F.lit("|"), role).alias("d2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
    ).where("conv_id IS NOT NULL")
    placed = numbered(rows, "conv_id", ["turn", "d1", "d2"], "turns").drop("turn")
    few = F.when(F.col("pos") < shared, F.struct("pos", "d1", "d2", "n_words"))
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(few)).alias("first"))
    convs = stored(convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % shared), "conversations")
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("first").alias("begin"))
    convs = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % family).drop("first").join(heads, "head", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("begin"), F.lit(0)).cast("long"))
    taken = F.when(F.col("begin").isNull(), F.lit(0)).otherwise(taken)
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "h", "taken", "length", F.slice("begin", 1, F.col("taken").cast("int")).alias("begin")), "rebuilt")
    given = convs.select("conv_id", F.lit(-1).alias("part"), "length", F.inline("begin"))
    own = placed.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % shared)
    own = own.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    names = ["conv_id", "part", F.col("pos").alias("depth"), "d1", "d2", "n_words", "length"]
    return given.select(*names).unionByName(own.select(*names)), convs.select("conv_id", "length")


def members(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, n_words, is_last: the nodes that each conversation passes, but for the root.

    Sums run within the rows of a conversation and part; what lies before a part is added.
    """
    rows = turns.select("conv_id", "part", "depth", "n_words", "length", *_halves(F.col("depth").cast("long")))
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(*[F.sum(x).alias(x) for x in HALVES])
    parts = parts.select("conv_id", "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in HALVES])
    rows = rows.select("*", *[F.sum(x).over(within).alias(f"{x}_sum") for x in HALVES]).join(parts, ["conv_id", "part"])
    upto = [F.col(f"{x}_sum") + F.col(f"{x}_before") for x in HALVES]
    above = [y - F.col(x) for x, y in zip(HALVES, upto, strict=True)]
    return rows.select(
        "conv_id",
        "depth",
        _name(F.col("depth"), upto).alias("node"),
        _name(F.col("depth") - 1, above).alias("parent"),
        "n_words",
        (F.col("depth") == F.col("length")).alias("is_last"),
    )


def subtree_sums(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """``node`` and, for each of some columns, the sum over the node's subtree, itself included.

    ``nodes`` has node, parent (null for a root) and the columns, whole numbers without nulls;
    a forest is as good as a tree. An empty table gives no rows.
    """
    live = stored(nodes.select("node", "parent", *values, *[F.lit(0).cast("long").alias(f"{x}_edge") for x in values]), "tree")
    raked, cut, turn = [], [], 0
    while not live.isEmpty():
        turn += 1
        children = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("k"), F.max("node").alias("child"))
        known = live.join(children, F.col("node") == F.col("of"), "left").drop("of")
        rank = lambda name, turn=turn: F.xxhash64(F.lit(turn), name)
        least = (rank("node") < rank("parent")) & (rank("node") < rank("child"))
        known = known.withColumn("cut", F.coalesce((F.col("k") == 1) & F.col("parent").isNotNull() & least, F.lit(False)))
        # Compress: the child takes the place of a node that is cut out, and what that was worth goes to its edge.
        gone = known.where("cut").select(
            F.col("node").alias("gone"), F.col("parent").alias("above"), *[F.col(x).alias(f"{x}_own") for x in values],
            *[F.col(f"{x}_edge").alias(f"{x}_up") for x in values],
        )
        left = known.where("NOT cut").join(gone, F.col("parent") == F.col("gone"), "left")
        left = left.select(
            "node", F.coalesce("above", "parent").alias("parent"), "k", "gone", *values,
            *[(F.col(f"{x}_own") + F.col(f"{x}_edge")).alias(f"{x}_gone") for x in values],
            *[(F.col(f"{x}_edge") + F.coalesce(F.col(f"{x}_own") + F.col(f"{x}_up"), F.lit(0))).alias(f"{x}_edge") for x in values],
        )
        left = stored(left, "compressed")
        cut.append(left.where("gone IS NOT NULL").select(F.col("gone").alias("node"), F.col("node").alias("next"), *[F.col(f"{x}_gone").alias(x) for x in values]))
        # Rake: all leaves are done, and are added to their parents.
        leaves = left.where("k IS NULL")
        raked.append(leaves.select("node", *values))
        added = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of"))
        added = added.agg(*[F.sum(F.col(x) + F.col(f"{x}_edge")).alias(f"{x}_added") for x in values])
        rest = left.where("k IS NOT NULL").join(added, F.col("node") == F.col("of"), "left")
        edges = [f"{x}_edge" for x in values]
        live = stored(rest.select("node", "parent", *[(F.col(x) + F.coalesce(f"{x}_added", F.lit(0))).alias(x) for x in values], *edges), "tree")
    if not raked:
        return nodes.select("node", *values)
    done, open_ = raked[0], cut[0]
    for frame in raked[1:]:
        done = done.unionByName(frame)
    for frame in cut[1:]:
        open_ = open_.unionByName(frame)
    done = stored(done, "raked")
    # Expand: a node that was cut out leads to its child, which may have been cut out in a later round.
    open_ = stored(open_, "contracted")
    for _ in range((turn - 1).bit_length()):
        further = open_.select(F.col("node").alias("next"), F.col("next").alias("after"), *[F.col(x).alias(f"{x}_more") for x in values])
        step = open_.join(further, "next", "left")
        added = [(F.col(x) + F.coalesce(f"{x}_more", F.lit(0))).alias(x) for x in values]
        open_ = stored(step.select("node", F.coalesce("after", "next").alias("next"), *added), "contracted")
    ends = done.select(F.col("node").alias("next"), *[F.col(x).alias(f"{x}_end") for x in values])
    return done.unionByName(open_.join(ends, "next").select("node", *[(F.col(x) + F.col(f"{x}_end")).alias(x) for x in values]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conv_id) in order in; per node the digest of its ids, comma-joined, out. An open node is held as a hash state."""
    last, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, ids = batch.column("node"), batch.column("conv_id").cast(pa.string())
        starts = starts_of_runs(nodes, last)
        places = np.flatnonzero(starts)
        done = []
        for a, b in zip([0, *places.tolist()], [*places.tolist(), len(ids)], strict=True):
            if a == b:
                continue
            if starts[a]:
                if state:
                    done.append((last.as_py(), state.hexdigest()))
                state, last = hashlib.sha256(), nodes[a]
            else:
                state.update(b",")
            state.update(",".join(ids[a:b].to_pylist()).encode())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
    if state:
        yield pa.record_batch([pa.array([last.as_py()]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the digest of a node's ids in numerical order.

    A digest over one list is made in one place; the ids of a node stream through a single
    task, sorted by Spark and never held together.
    """
    sorted_ = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return sorted_.mapInArrow(_digests, "node STRING, ends_sha256 STRING")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    Nodes are the distinct beginnings, by (role, text), of the conversations that
    ``rebuilt_turns`` gives, from the root without a turn. ``conv_id`` is the least id of the
    conversations that begin so, ``n_convs`` their number; ``saved_tokens`` sums, over the
    subtree, (n_convs - 1) times the words in the node's last text; ``ends_sha256`` is the digest of the
    ids of conversations that end there. Without a conversation there is no node.
    """
    turns, convs = rebuilt_turns(conversations, family, shared)
    passed = stored(members(turns), "members")
    nodes = passed.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").cast("long").alias("depth"),
        F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"),
        F.min("n_words").alias("n_words"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    no_parent, zero = F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long")
    root = root.select(_root().alias("node"), "conv_id", zero.alias("depth"), no_parent, "n_convs", zero.alias("n_words"))
    nodes = stored(nodes.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    nodes = stored(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_words")), "nodes")
    totals = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    empty = convs.where("length = 0").select(_root().alias("node"), "conv_id")
    digests = end_digests(passed.where("is_last").select("node", "conv_id").unionByName(empty))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(digests, "node", "left").join(parents, "parent", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
