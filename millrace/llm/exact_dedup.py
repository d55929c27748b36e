"""Exact deduplication by sorting contents.

Sampled splitters deal the texts out in sorted ranges, an external sort puts equal texts
side by side, and each text is compared in full with its neighbour. A group of copies may
lie across any number of ranges, because equal texts are dealt out further by their id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of

# Splitters are sampled on the driver, so they hold the first characters and a hash, not whole texts.
SPLITTER_CHARS = 32

# A row of the input (n is null) or a run of more than one row, or at an end of its task's rows.
RUN_SCHEMA = "doc_id BIGINT, digest BINARY, part INT, run BIGINT, n BIGINT"


def _runs(largest: bool):
    """Rows in text order in; out each row with its text's digest and run, and each run with its best id and number of rows.

    One digest is made per run. Rows go out as they come; of the open run only the count and the best id are held.
    """
    better = max if largest else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last_text, digest, n, best = TaskContext.get().partitionId(), -1, None, None, 0, None

        def record(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [("doc_id", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("run", pa.int64()), ("n", pa.int64())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[x for x, _ in kinds])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, out = batch.column("text"), []
            differs = [True, *pc.not_equal(texts[1:], texts[:-1]).to_pylist()]
            differs[0] = last_text is None or texts[0].as_py() != last_text
            for row, (new, doc_id) in enumerate(zip(differs, batch.column("doc_id").to_pylist(), strict=True)):
                if new:
                    if n > 1 or number == 0:
                        out.append((best, digest, part, number, n))
                    number, n, best = number + 1, 0, None
                    digest = hashlib.sha256(texts[row].as_buffer()).digest()
                n += 1
                if doc_id is not None:
                    best = doc_id if best is None else better(best, doc_id)
                out.append((doc_id, digest, part, number, None))
            last_text = texts[len(texts) - 1].as_py()
            yield record(out)
        if n:
            yield record([(best, digest, part, number, n)])

    return run


def exact_groups(docs: DataFrame, keep: str = "smallest", normalise: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" doc_id of a group of equal texts; ``normalise`` is
    the text to compare instead of the plain column. A null text counts as empty. Rows that
    repeat a doc_id in a group are all kept or all dropped; a null doc_id is kept only in a
    group without any other. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    text = text_of(docs) if normalise is None else F.coalesce(normalise, F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.substring("text", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("text").alias("hash"))
    in_order = rows.repartitionByRange("head", "hash", "doc_id").sortWithinPartitions("head", "hash", "text", "doc_id")
    found = stored(in_order.select("doc_id", "text").mapInArrow(_runs(keep == "largest"), RUN_SCHEMA), "runs")
    # Runs of the same text, which a border between tasks has cut, are added up.
    runs = found.where("n IS NOT NULL").select("digest", "part", "run", "n", F.col("doc_id").alias("best"))
    best = F.min("best") if keep == "smallest" else F.max("best")
    groups = runs.groupBy("digest").agg(best.alias("keep"), F.sum("n").alias("total")).where("total > 1")
    # Written, so that the join below deals out both sides itself and can split a large run.
    groups = stored(runs.select("digest", "part", "run").join(groups, "digest").select("part", "run", "keep", "total"), "groups")
    rows = found.where("n IS NULL").join(groups, ["part", "run"], "left")
    keep_id = F.when(F.col("total") > 1, F.col("keep")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("total", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeated_rows(docs: DataFrame) -> DataFrame:
    """One row of those that share a doc_id and a text, all columns; null is an id like others, a null text is empty.

    It is the one whose columns, written as JSON, come first. Only rows that are repeated are moved.
    """
    names, text = docs.columns, text_of(docs)
    keys = ["key_id", "key_1", "key_2"]
    key = [docs["doc_id"].cast("long").alias("key_id"), F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit("|"), text).alias("key_2")]
    rows = docs.select(*key, F.struct(*[docs[name] for name in names]).alias("r"))
    repeated = docs.select(*key).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(repeated.select(*[F.col(x).alias(f"{x}_") for x in keys]), "repeated-rows")
    if repeated.isEmpty():
        return docs
    same = F.lit(True)
    for x in keys:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_"))
    first = rows.join(repeated, same, "left_semi").groupBy(*keys).agg(F.min_by("r", F.to_json("r")).alias("r"))
    return rows.join(repeated, same, "left_anti").select("r.*").unionByName(first.select("r.*"))


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The documents, with one row of each group of equal texts; one without a doc_id stays only if none has one."""
    docs = drop_repeated_rows(docs)
    dropped = exact_groups(docs, keep).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"), "text_sha256").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(dropped["dropped_id"]) & (F.sha2(text_of(docs), 256) == dropped["text_sha256"])
    return docs.join(dropped, same, "left_anti")
