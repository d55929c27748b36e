"""Sharding by a k-d tree, in DataFrame operations only.

A node is split along its widest dimension at the weighted median, weights being bytes,
until every leaf is one shard of about the target size. A median is found for all nodes of
a level at once, by sums of weights over ever finer ranges of a 56-bit key: the coordinate
in the upper 24 bits and a hash that orders rows of equal coordinates in the lower 32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_broadcast, literal_rows, stored, text_of
from millrace.session import scratch_dir
from millrace.storage import delete

COORDINATE_BITS, TIE_BITS = 24, 32
STEP_BITS = 14  # of the key, found per pass: 2 ** 14 sums per node and pass
ROW_BYTES = 16  # counted for a row besides its text
# Equal texts stay together unless they make up more than this share of a shard.
GROUP_SHARE = 0.125
SLOT_BLOCKS = 64


def _category(column: Column) -> Column:
    """Values of a category lie anywhere, but equal ones at the same place; null is a value."""
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit("\x00"))), F.lit(1 << COORDINATE_BITS))


def _amount(column: Column) -> Column:
    """Amounts on a logarithmic scale; null counts as none."""
    scaled = F.log2(F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * (1 << (COORDINATE_BITS - 6))
    return F.least(F.floor(scaled), F.lit((1 << COORDINATE_BITS) - 1)).cast("long")


def _coordinates(docs: DataFrame) -> list[Column]:
    """The metadata dimensions: language, source, length and id."""
    at = {name.lower(): docs[name] for name in docs.columns}
    none = F.lit(None)
    return [
        _category(at.get("lang", none)).alias("x0"),
        _category(at.get("source", none)).alias("x1"),
        _amount(F.length(text_of(docs))).alias("x2"),
        _amount(docs["doc_id"]).alias("x3"),
    ]


DIMENSIONS = ("x0", "x1", "x2", "x3")


def _rows(docs: DataFrame, shards: int, group_share: float) -> DataFrame:
    """doc_id, size, text_crc32, coordinates and tie of every row; no texts.

    Rows of equal texts have the coordinates of the one with the least doc_id and the same
    tie, so that no split parts them; those of a group that is too large get a tie each.
    """
    text = text_of(docs)
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
        *_coordinates(docs),
    )
    base = stored(base, "rows")
    total = base.agg(F.sum("size")).first()[0] or 0
    groups = base.groupBy("content", "text_crc32", "size").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), *DIMENSIONS)).alias("least")
    )
    groups = stored(groups.where("copies > 1"), "copies")  # written, so that the join can split a large group
    rows = base.join(groups, ["content", "text_crc32", "size"], "left")
    together = F.col("copies") * F.col("size") <= F.lit(total * group_share / shards)
    tie = F.when(together, F.xxhash64("content", "size")).otherwise(F.xxhash64("content", "size", "doc_id"))
    moved = [F.when(together, F.col("least")[x]).otherwise(F.col(x)).alias(x) for x in DIMENSIONS]
    return rows.select("doc_id", "size", "text_crc32", *moved, F.pmod(tie, F.lit(1 << TIE_BITS)).alias("tie"))


def _cuts(rows: DataFrame, parts: dict[int, int]) -> dict[int, tuple[str, int]]:
    """For each node, by its first shard: the widest dimension and the last key of its lower half.

    The collected rows are one per node, of which there are fewer than shards.
    """
    widths = [(F.max(x) - F.min(x)).alias(x) for x in DIMENSIONS]
    wide = rows.where(F.col("node").isin([n for n, k in parts.items() if k > 1])).groupBy("node").agg(F.sum("size").alias("size"), *widths)
    state = {}  # node: dimension, prefix of the key so far, weight still wanted below
    for row in wide.collect():
        dimension = max(DIMENSIONS, key=lambda x: (row[x], -DIMENSIONS.index(x)))
        state[row["node"]] = (dimension, 0, row["size"] * (parts[row["node"]] // 2) / parts[row["node"]])
    spark = rows.sparkSession
    left_bits = COORDINATE_BITS + TIE_BITS
    while left_bits and state:
        table = literal_rows(spark, [(n, *s) for n, s in state.items()], "node INT, dimension STRING, prefix BIGINT, wanted DOUBLE")
        table = bounded_broadcast(table, len(state), 64)
        shift = left_bits - STEP_BITS
        keyed = rows.join(table, "node").withColumn("key", _key(F.col("dimension")))
        keyed = keyed.where(F.shiftright("key", left_bits) == F.col("prefix"))
        sums = keyed.groupBy("node", "wanted", F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("size"))
        # At most 2 ** STEP_BITS sums of a node.
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("node").orderBy("prefix")))
        best = F.when(F.col("upto") >= F.col("wanted"), F.col("prefix"))
        last = sums.groupBy("node").agg(F.coalesce(F.min(best), F.max("prefix")).alias("prefix"))
        chosen = sums.join(last, ["node", "prefix"]).select("node", "prefix", "size", "upto", "wanted").collect()
        done = shift == 0
        for row in chosen:
            dimension, _, wanted = state[row["node"]]
            before = row["upto"] - row["size"]
            prefix = row["prefix"]
            if done and wanted - before < row["upto"] - wanted:
                prefix -= 1  # the boundary below the last key is nearer
            state[row["node"]] = (dimension, prefix, wanted - before)
        left_bits = shift
    return {node: (dimension, prefix) for node, (dimension, prefix, _) in state.items()}


def _key(dimension: Column) -> Column:
    coordinate = F.coalesce(*(F.when(dimension == x, F.col(x)) for x in DIMENSIONS))
    return F.shiftleft(coordinate, TIE_BITS) + F.col("tie")


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, group_share: float = GROUP_SHARE
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row of the input in one shard.

    Give the number of shards, or the bytes that a shard should have. Sizes are those of the
    texts in UTF-8 (null: none) plus 16 bytes a row, and shards differ by about the largest
    row or group of copies that a cut meets; with fewer rows than shards, some shards are
    empty. Slots number the rows of a shard without gaps. Null metadata is a value of its own.
    Equal texts lie together, unless they fill more than ``group_share`` of a shard: then they are
    dealt out by doc_id, and those of one doc_id lie together.
    """
    if shards is None:
        total = docs.agg(F.sum(F.octet_length(text_of(docs)) + ROW_BYTES)).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    spark = docs.sparkSession
    path = scratch_dir(spark, "kd-level")
    rows = stored(_rows(docs, shards, group_share).withColumn("node", F.lit(0)), "kd-level", path)
    parts = {0: shards}
    while any(k > 1 for k in parts.values()):
        cuts = _cuts(rows, parts)
        table = [(node, parts[node] // 2, *cut) for node, cut in cuts.items()]
        table = literal_rows(spark, table, "node INT, lower INT, dimension STRING, last BIGINT")
        above = F.coalesce((_key(F.col("dimension")) > F.col("last")).cast("int") * F.col("lower"), F.lit(0))
        moved = rows.join(bounded_broadcast(table, len(cuts), 64), "node", "left").withColumn("node", F.col("node") + above)
        older, path = path, scratch_dir(spark, "kd-level")
        rows = stored(moved.drop("lower", "dimension", "last"), "kd-level", path)
        delete(spark, older)
        halves = [(n, k // 2) for n, k in parts.items()] + [(n + k // 2, k - k // 2) for n, k in parts.items()]
        parts = {n: k for n, k in halves if k}
    return _slots(rows.withColumnRenamed("node", "shard"))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard: blocks of a shard are counted, then numbered in parallel."""
    # Repeated rows go to different blocks.
    spread = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", spread), F.lit(SLOT_BLOCKS)).cast("int")), "blocks")
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "tie"))
    numbered = rows.withColumn("inside", inside - 1).join(counts, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents as Parquet, one folder per shard. Every doc_id must stand for one text."""
    chosen = assigned.select(F.col("doc_id").alias("assigned_id"), F.col("shard").alias("to_shard")).distinct()
    rows = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["assigned_id"])).drop("assigned_id")
    rows.repartition("to_shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("to_shard").parquet(path)
