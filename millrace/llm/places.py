"""Positions of rows within their groups, without a group ever being in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from millrace.llm.common import bounded_broadcast, stored


def starts_of_runs(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """For each value whether it differs from the one before it; ``before`` comes before the first. Nulls are equal."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        out[1:] = ~(same | (nulls[1:] & nulls[:-1]))
    if before is not None and len(column):
        out[0] = before.as_py() != column[0].as_py()
    return out


def _local_places(key: str):
    """Sorted rows in; the same with the number of the task, and the place of each among the task's rows of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = starts_of_runs(batch.column(key), last)
            index = np.arange(n, dtype=np.int64)
            since = np.maximum.accumulate(np.where(starts, index, -1))
            places = np.where(since >= 0, index - since, index + held) + 1
            last, held = batch.column(key)[n - 1], int(places[-1])
            names = [*batch.schema.names, "part", "place"]
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places)], names=names)

    return run


def numbered(rows: DataFrame, key: str, order: Sequence[str], label: str) -> DataFrame:
    """The rows with ``pos``, from 1, in the order of some columns within each key, nulls first; and ``part``.

    Rows are dealt out by ranges of (key, order) and sorted there, so that a large group lies in
    several tasks; rows equal in all of these are parted too. What comes before a task's rows of
    a key is added from counts per task and key, of which all but one per task are zero. The rows of
    a key and part are consecutive, and parts are in order. The result is written and read back.
    """
    spark = rows.sparkSession
    names = rows.columns
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(key, *order, "__row").sortWithinPartitions(key, *order).select(*names)
    schema = StructType([*dealt.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])
    saved = stored(dealt.mapInArrow(_local_places(key), schema), label)
    counts = saved.groupBy(key, "part").agg(F.max("place").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    further = counts.select(F.col(key).alias("__key"), F.col("part").alias("__part"), earlier.alias("__before")).where("__before > 0")
    further = bounded_broadcast(further, int(spark.conf.get("spark.sql.shuffle.partitions")), 256)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part"))
    pos = (F.col("place") + F.coalesce("__before", F.lit(0))).alias("pos")
    return saved.join(further, same, "left").select(*names, "part", pos)
