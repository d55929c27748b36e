"""Keyed refresh by merging on read.

A batch is appended as a run of its own, a number that grows; nothing that is there is rewritten.
Readers take, for each key, the rows of the newest run that has it; rows whose key is NULL match
nothing and all stay, unless NULL equals NULL (``null_safe``). The rows lie in buckets that depend
on the keys alone, so readers compare rows within a bucket, and folding works bucket by bucket:
where ``FAN`` runs of a level have come together, they become one run of the next level. A run that
spans others takes their place when its partition appears, so each bucket is switched in one step.

What the newest run of a key replaces is found by an anti-join of all runs with the keys of the later
ones; the first run, by far the largest, is only on its left side. Rows lie sorted by key in their
files, which have Bloom filters on the keys, so that ``lookup`` reads little for a few keys.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.layout import TABLE_OPTIONS, ensure_layer, partition_values, property_of
from millrace.session import scratch_dir

BUCKET = "key_bucket"
LAYOUT_COLUMNS = (BUCKET, "run_level", "run_first", "run_last")
RULE, KEYS, NULL_SAFE = "millrace.bucket", "millrace.keys", "millrace.null_safe"
# Of a bucket of hashed keys, when a table is laid out for the first time, and the least number of them.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 8
FAN = 8
# Each halves the largest size, so that small row groups get small filters.
BLOOM_FILTERS = {"enabled": "true", "candidates.number": "12"}

Part = tuple[str, int, int, int]  # bucket, level, first and last run


def parts_of(spark: SparkSession, table: str) -> list[Part]:
    """The parts of a table, one per bucket and run, from the catalog alone."""
    if not spark.catalog.tableExists(table):
        return []
    return sorted((bucket, *map(int, rest)) for bucket, *rest in partition_values(spark, table))


def _spans(part: Part, other: Part) -> bool:
    return part[0] == other[0] and part[1] > other[1] and part[2] <= other[2] and other[3] <= part[3]


def last_run(spark: SparkSession, table: str) -> int | None:
    return max((last for _, _, _, last in parts_of(spark, table)), default=None)


def create_keyed(
    spark: SparkSession, table: str, like: DataFrame, keys: Sequence[str], rule: str, null_safe: bool = False, root: str | None = None
) -> None:
    """Create a table for batches like a given one if absent; ``rule`` is a SQL expression over the keys."""
    ensure_layer(spark, table.split(".")[0], root)
    columns = ", ".join(f"{storage.quoted(field.name)} {field.dataType.simpleString()}" for field in like.schema)
    # Readers of a few keys skip row groups by these filters, made as large as a row group needs.
    filters = ", 'parquet.bloom.filter.adaptive.enabled' 'true'" + "".join(
        f", {storage.literal(f'parquet.bloom.filter.{name}#{key}')} '{value}'" for key in keys for name, value in BLOOM_FILTERS.items()
    )
    properties = {RULE: f"coalesce(cast({rule} as bigint), -1)", KEYS: json.dumps(list(keys)), NULL_SAFE: json.dumps(null_safe)}
    listed = ", ".join(f"{storage.literal(name)} = {storage.literal(value)}" for name, value in properties.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {BUCKET} BIGINT, run_level INT, run_first BIGINT, run_last BIGINT) "
        f"USING parquet OPTIONS ({TABLE_OPTIONS}{filters}) PARTITIONED BY ({', '.join(LAYOUT_COLUMNS)}) TBLPROPERTIES ({listed})"
    )


def merge_batch(
    batch: DataFrame,
    table: str,
    keys: Sequence[str],
    bucket: str | None = None,
    buckets: int | None = None,
    null_safe: bool = False,
    root: str | None = None,
    run: int | None = None,
    session: SparkSession | None = None,
    fan: int = FAN,
) -> int:
    """Keyed refresh of a stored table that writes the batch and no more; returns the batch's run.

    Later runs replace earlier ones key by key; duplicates within a batch stay. ``bucket`` is a
    SQL expression over the keys; by default keys are hashed into ``buckets``, of about 64 MB of
    the first batch each. ``run`` makes a repeated batch replace itself: give the same number with
    the same rows; it is left out if it has been folded already. Read with ``merged``.
    ``session`` is the session to work in, for the batches of a stream.
    """
    spark = session or batch.sparkSession
    staged_path = scratch_dir(spark, "merge")
    try:
        # Written once: it is measured and then laid out.
        batch.write.parquet(staged_path)
        staged = spark.read.schema(batch.schema).parquet(staged_path)
        if not spark.catalog.tableExists(table):
            number = buckets or max(LEAST_BUCKETS, -(-storage.size(spark, staged_path) // BUCKET_BYTES))
            names = ", ".join(storage.quoted(key) for key in keys)
            create_keyed(spark, table, batch, keys, bucket or f"pmod(xxhash64({names}), {number})", null_safe, root)
        there = parts_of(spark, table)
        run = max((last for *_, last in there), default=-1) + 1 if run is None else run
        if any(level and first <= run <= last for _, level, first, last in there):
            return run
        names = [field.name for field in spark.table(table).schema if field.name not in LAYOUT_COLUMNS]
        if sorted(names) != sorted(batch.columns):
            raise ValueError(f"{table} has the columns {names}, the batch has {batch.columns}")
        placed = staged.select(*names).withColumn(BUCKET, F.expr(property_of(spark, table, RULE)))
        _write(placed.withColumns({"run_level": F.lit(0), "run_first": F.lit(run).cast("long"), "run_last": F.lit(run).cast("long")}), table, keys)
    finally:
        storage.delete(spark, staged_path)
    fold_runs(spark, table, fan)
    return run


def _write(rows: DataFrame, table: str, keys: Sequence[str]) -> None:
    # A rebalance gives each bucket few files and splits one that is much larger.
    rows = rows.hint("rebalance", BUCKET).sortWithinPartitions(*LAYOUT_COLUMNS, *[storage.quoted(key) for key in keys])
    rows.write.insertInto(table, overwrite=True)
    rows.sparkSession.catalog.refreshTable(table)


def _keys_of(spark: SparkSession, table: str) -> list[str]:
    return json.loads(property_of(spark, table, KEYS))


def _same_key(keys: Sequence[str], ours: str, theirs: str, null_safe: bool) -> str:
    names = [storage.quoted(key) for key in keys]
    return " AND ".join(f"{ours}.{name} {'<=>' if null_safe else '='} {theirs}.{name}" for name in names)


def merged_sql(spark: SparkSession, table: str, only: str = "true") -> str:
    """SQL for the rows that count, with their layout columns; for a view, whatever the runs are when it is read.

    ``only`` is a condition that takes whole keys, whole buckets or, of a bucket, consecutive runs.
    """
    keys, null_safe = _keys_of(spark, table), json.loads(property_of(spark, table, NULL_SAFE))
    names = ", ".join(f"p.{storage.quoted(name)}" for name in spark.table(table).columns)
    key_names = ", ".join(storage.quoted(key) for key in keys)
    # A run that others span doesn't count. Later runs are taken as they are, spanned or not: what
    # they replace is replaced by the run that spans them too. The first run replaces nothing.
    return f"""
SELECT {names} FROM (SELECT * FROM {table} WHERE {only}) p
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT {', '.join(LAYOUT_COLUMNS)} FROM {table}) w
  WHERE w.{BUCKET} = p.{BUCKET} AND w.run_level > p.run_level AND w.run_first <= p.run_first AND p.run_last <= w.run_last)
AND NOT EXISTS (
  SELECT 1 FROM (SELECT {key_names}, {BUCKET}, max(run_last) AS run_last FROM {table} WHERE run_first > 0 AND ({only}) GROUP BY {key_names}, {BUCKET}) n
  WHERE n.{BUCKET} = p.{BUCKET} AND n.run_last > p.run_last AND {_same_key(keys, 'n', 'p', null_safe)})"""


def merged(spark: SparkSession, table: str) -> DataFrame:
    """The table as of its newest runs, without layout columns."""
    return spark.sql(merged_sql(spark, table)).drop(*LAYOUT_COLUMNS)


def lookup(spark: SparkSession, table: str, wanted: DataFrame, most: int = 1000) -> DataFrame:
    """The rows of some keys, as of the newest runs; ``wanted`` has the key columns. NULL keys match nothing.

    Up to ``most`` keys are put into the scan itself, each as an equality: it reads only the keys'
    buckets, and of their files the row groups that sorting, statistics and Bloom filters leave.
    More keys are joined.
    """
    keys = _keys_of(spark, table)
    wanted = wanted.select(*keys).dropna().distinct()
    found = wanted.withColumn(BUCKET, F.expr(property_of(spark, table, RULE))).limit(most + 1).collect()
    if len(found) > most:
        return merged(spark, table).join(wanted, keys, "left_semi")
    if not found:
        return merged(spark, table).where(F.lit(False))
    kinds = {field.name: field.dataType.simpleString() for field in wanted.schema}
    value = lambda row, key: f"CAST({storage.literal(str(row[key]))} AS {kinds[key]})"
    same = [" AND ".join(f"{storage.quoted(key)} = {value(row, key)}" for key in keys) for row in found]
    buckets = ", ".join(sorted({str(row[BUCKET]) for row in found}))
    return spark.sql(merged_sql(spark, table, f"{BUCKET} IN ({buckets}) AND (({') OR ('.join(same)}))")).drop(*LAYOUT_COLUMNS)


def fold_runs(spark: SparkSession, table: str, fan: int = FAN) -> list[Part]:
    """Make one run of ``fan`` runs of a bucket and level, in the buckets that have so many; returns the new parts.

    Only those buckets are read and written, all of one level in one job. Parts that had been
    folded before are dropped first; those that are folded now stay until the next time, for
    readers that have begun.
    """
    found = parts_of(spark, table)
    by_bucket: dict[str, list[Part]] = {}
    for part in found:
        by_bucket.setdefault(part[0], []).append(part)
    live, gone = [], []
    for own in by_bucket.values():
        for part in own:
            (gone if any(_spans(other, part) for other in own) else live).append(part)
    if gone:
        places = ", ".join(f"PARTITION ({BUCKET} = {b}, run_level = {level}, run_first = {a}, run_last = {z})" for b, level, a, z in gone)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {places}")
        spark.catalog.refreshTable(table)
    made: list[Part] = []
    for level in sorted({part[1] for part in live}):
        same: dict[str, list[Part]] = {}
        for part in (*live, *made):
            if part[1] == level:
                same.setdefault(part[0], []).append(part)
        due = {bucket: (min(p[2] for p in own), max(p[3] for p in own)) for bucket, own in same.items() if len(own) >= fan}
        # Buckets in which the same runs have come together, as is usual, are folded in one job.
        for first, last in sorted(set(due.values())):
            buckets = [bucket for bucket, place in due.items() if place == (first, last)]
            only = f"{BUCKET} IN ({', '.join(buckets)}) AND run_level = {level} AND run_first >= {first} AND run_last <= {last}"
            rows = spark.sql(merged_sql(spark, table, only))
            _write(rows.withColumns({"run_level": F.lit(level + 1), "run_first": F.lit(first).cast("long"), "run_last": F.lit(last).cast("long")}), table, _keys_of(spark, table))
            made += [(bucket, level + 1, first, last) for bucket in buckets]
    return made
