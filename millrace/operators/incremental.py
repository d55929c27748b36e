"""Stored tables that take one batch after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.layout import LOAD_COLUMNS, TABLE_OPTIONS, ensure_layer, load_place, property_of
from millrace.operators.relational import keyed_anti_join
from millrace.session import scratch_dir

BUCKET = "key_bucket"
BUCKET_PROPERTY = "millrace.bucket"
# Of a bucket of hashed keys, when a table is laid out for the first time.
BUCKET_BYTES = 64 << 20


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{storage.quoted(field.name)} {field.dataType.simpleString()}" for field in df.schema)


def create_loads(like: DataFrame, table: str, root: str | None = None) -> None:
    """Create a table for loads like a given one if absent."""
    spark = like.sparkSession
    ensure_layer(spark, table.split(".")[0], root)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({_columns(like)}, {LOAD_COLUMNS}) "
        f"USING parquet OPTIONS ({TABLE_OPTIONS}) PARTITIONED BY (load_day, load_id)"
    )


def append_load(df: DataFrame, table: str, load_id: str, root: str | None = None) -> None:
    """Append a batch as the load ``load_id`` of a stored table, creating it if absent.

    Only the new rows are touched, and a repeated load replaces itself. Columns go by
    name; a missing one or one too many is an error.
    """
    spark = df.sparkSession
    create_loads(df, table, root)
    names = [field.name for field in spark.table(table).schema if field.name not in ("load_day", "load_id")]
    if sorted(names) != sorted(df.columns):
        raise ValueError(f"{table} has the columns {names}, the batch has {df.columns}")
    columns = ", ".join(f"`{name}`" for name in names)
    spark.sql(f"INSERT OVERWRITE {table} PARTITION ({load_place(spark, table, load_id)}) SELECT {columns} FROM {{df}}", df=df)


def upsert_table(
    batch: DataFrame,
    table: str,
    keys: Sequence[str],
    bucket: str | None = None,
    buckets: int | None = None,
    null_safe: bool = False,
    root: str | None = None,
    merge_session: SparkSession | None = None,
) -> None:
    """Keyed refresh of a stored table that rewrites only the buckets the batch touches.

    The table is partitioned by a bucket that depends on the keys alone, so a row and its
    replacement always share a partition. ``bucket`` is a SQL expression over the keys,
    kept with the table. For keys that grow with time give a range (``id div 10000000``),
    so that a batch touches few buckets. Otherwise keys are hashed into ``buckets``; by
    default as many as give each about 64 MB of the first batch, so that what a batch of
    some keys rewrites is those keys times the size of a bucket and not the table. Give the
    number when the first batch is much smaller than the table will be.

    A stream's batch gives its caller's session as ``merge_session``: only writing the
    batch out runs in the stream's own session, which plans without adaptive execution.
    """
    spark = merge_session or batch.sparkSession
    ensure_layer(spark, table.split(".")[0], root)
    # The batch is read several times below: write it once.
    staged_path = scratch_dir(spark, "upsert")
    try:
        batch.write.parquet(staged_path)
        staged = spark.read.schema(batch.schema).parquet(staged_path)
        if not spark.catalog.tableExists(table):
            if not (bucket or buckets):
                buckets = max(64, -(-storage.size(spark, staged_path) // BUCKET_BYTES))
            names = ", ".join(storage.quoted(key) for key in keys)
            rule = f"coalesce(cast({bucket or f'pmod(xxhash64({names}), {buckets})'} as bigint), -1)"
            spark.sql(
                f"CREATE TABLE {table} ({_columns(batch)}, {BUCKET} BIGINT) USING parquet OPTIONS ({TABLE_OPTIONS}) "
                f"PARTITIONED BY ({BUCKET}) TBLPROPERTIES ({storage.literal(BUCKET_PROPERTY)} = {storage.literal(rule)})"
            )
        staged = staged.withColumn(BUCKET, F.expr(property_of(spark, table, BUCKET_PROPERTY)))
        current = spark.table(table)
        # On the partition column: the scan prunes to the buckets that the batch touches.
        touched = staged.select(F.col(BUCKET).alias("__touched")).distinct()
        affected = current.join(touched, F.col(BUCKET) == F.col("__touched"), "left_semi")
        kept = keyed_anti_join(affected, staged, keys, null_safe)
        result = kept.unionByName(staged.select(kept.columns))
        # A rebalance gives each bucket few files and splits a bucket that is much larger.
        result.hint("rebalance", BUCKET).write.insertInto(table, overwrite=True)
    finally:
        storage.delete(spark, staged_path)
