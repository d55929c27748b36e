"""Keyed and set operators on plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.layout import ensure_layer


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs, matched by column name; nothing is removed."""
    for other in others:
        first = first.unionByName(other)
    return first


def sort_nulls_last(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Ascending sort with NULLs at the end."""
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    return df.orderBy(*[column.asc_nulls_last() for column in columns])


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, root: str | None = None) -> None:
    """Store a table in buckets of its keys, each one file sorted by them, for joins that don't move it."""
    spark = df.sparkSession
    ensure_layer(spark, table.split(".")[0], root)
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)


def keyed_anti_join(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False, buckets: int | None = None
) -> DataFrame:
    """Target rows whose key is not in the batch.

    A NULL key matches nothing, so such rows stay; with ``null_safe`` NULL equals NULL.
    Catalyst broadcasts the batch keys only when their size is below its threshold. If the target
    is stored in so many ``buckets`` of the keys (``write_bucketed``), only the batch is dealt out,
    in the same way, and the target is read bucket by bucket without a shuffle. Without null_safe only.
    """
    batch_keys = batch.select(*[F.col(key).alias(f"__{key}") for key in keys])
    if not null_safe:
        batch_keys = batch_keys.dropna()
    if buckets and not null_safe:
        batch_keys = batch_keys.repartition(buckets, *batch_keys.columns)
    batch_keys = batch_keys.distinct()
    condition = F.lit(True)
    for key in keys:
        ours, theirs = F.col(key), F.col(f"__{key}")
        condition = condition & (ours.eqNullSafe(theirs) if null_safe else ours == theirs)
    return target.join(batch_keys, condition, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Delete and insert: target rows with a key of the batch go, all batch rows come."""
    return keyed_anti_join(target, batch, keys, null_safe).unionByName(batch)
