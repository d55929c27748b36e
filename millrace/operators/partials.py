"""Counts that each load appends for itself, summed when they are read.

A table of partial sums holds runs. A run has the sums of one or more consecutive batches of a
stream, in a partition that says which: (stream, level, first, last). A load adds a run of its own;
when ``FAN`` runs of a level are there, folding adds them up in a run of the next level, so that
each row is rewritten a few times (the logarithm of the number of loads) and a table never has more
than a few runs per level. A run counts unless one of a higher level spans its batches. So a folded run takes the place
of its parts at the moment it appears, in one step for every reader; the parts are dropped by the
next folding. Which batches a table has taken in is known from its runs, however many they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.layout import TABLE_OPTIONS, ensure_layer, partition_values

LAYER = "partials"
RUN_COLUMNS = ("run_stream", "run_level", "run_first", "run_last")
FAN = 8


@dataclass(frozen=True)
class Run:
    """Batches ``first`` to ``last`` of a stream."""

    stream: str
    level: int
    first: int
    last: int

    def spans(self, other: Run) -> bool:
        return self.stream == other.stream and self.level > other.level and self.first <= other.first and other.last <= self.last

    def has(self, stream: str, batch: int) -> bool:
        return self.stream == stream and self.first <= batch <= self.last

    @property
    def place(self) -> str:
        return (
            f"run_stream = {storage.literal(self.stream)}, run_level = {self.level}, run_first = {self.first}, run_last = {self.last}"
        )


def batch_of(load_id: str) -> tuple[str, int]:
    """Stream and number of a load; a load of another name is a stream of its own."""
    stream, _, number = load_id.rpartition("-")
    return (stream, int(number)) if stream and number.isdigit() else (load_id, 0)


def partial_table(name: str) -> str:
    return storage.quoted(f"{LAYER}.{name}")


def runs_of(spark: SparkSession, table: str) -> list[Run]:
    """All runs of a table, from the catalog alone; none if there is no such table."""
    if not spark.catalog.tableExists(table):
        return []
    return sorted((Run(stream, *map(int, rest)) for stream, *rest in partition_values(spark, table)), key=lambda r: (r.stream, r.first, r.level))


def counted(runs: Iterable[Run]) -> list[Run]:
    """The runs that count: those that no other one spans."""
    runs = list(runs)
    return [run for run in runs if not any(other.spans(run) for other in runs)]


def is_taken(runs: Iterable[Run], load_id: str) -> bool:
    return any(run.has(*batch_of(load_id)) for run in runs)


def create_partials(sums: DataFrame, table: str, root: str | None = None) -> None:
    """Create a table for such sums if absent."""
    spark = sums.sparkSession
    ensure_layer(spark, LAYER, root)
    columns = ", ".join(f"{storage.quoted(field.name)} {field.dataType.simpleString()}" for field in sums.schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, run_stream STRING, run_level INT, run_first BIGINT, run_last BIGINT) "
        f"USING parquet OPTIONS ({TABLE_OPTIONS}) PARTITIONED BY ({', '.join(RUN_COLUMNS)})"
    )


def append_run(sums: DataFrame, table: str, run: Run, root: str | None = None) -> None:
    """Write sums as a run, creating the table if absent; a repeated run replaces itself. Columns go by name."""
    spark = sums.sparkSession
    create_partials(sums, table, root)
    names = [field.name for field in spark.table(table).schema if field.name not in RUN_COLUMNS]
    if sorted(names) != sorted(sums.columns):
        raise ValueError(f"{table} has the columns {names}, the sums have {sums.columns}")
    place = [F.lit(run.stream), F.lit(run.level), F.lit(run.first).cast("long"), F.lit(run.last).cast("long")]
    rows = sums.select(*names, *[value.alias(name) for value, name in zip(place, RUN_COLUMNS, strict=True)])
    # Sums are few; one file a run, unless adaptive execution finds them large.
    rows.hint("rebalance").write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    note_run(spark, table, run)


def note_run(spark: SparkSession, table: str, run: Run) -> None:
    """Have a run in the catalog, also if it holds no row."""
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({run.place})")


def _measures(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in keys and name not in RUN_COLUMNS]


def fold(spark: SparkSession, table: str, keys: Sequence[str], fan: int = FAN) -> list[Run]:
    """Add up runs where ``fan`` of a stream and level have come together; returns the new ones.

    Runs that already were part of another one are dropped first. Those that are folded now
    stay until the next time, for readers that have begun.
    """
    found = runs_of(spark, table)
    live = counted(found)
    for run in found:
        if run not in live:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({run.place})")
    made = []
    for stream in sorted({run.stream for run in live}):
        for level in sorted({run.level for run in live if run.stream == stream}):
            # Runs of higher levels are older, so those of one level are consecutive.
            same = [run for run in (*live, *made) if run.stream == stream and run.level == level]
            if len(same) < fan:
                continue
            run = Run(stream, level + 1, min(r.first for r in same), max(r.last for r in same))
            parts = spark.table(table).where(
                (F.col("run_stream") == stream) & (F.col("run_level") == level) & F.col("run_first").between(run.first, run.last)
            )
            append_run(_summed(parts, keys), table, run)
            made.append(run)
    if made or len(live) < len(found):
        spark.catalog.refreshTable(table)
    return made


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum(name).cast(parts.schema[name].dataType).alias(name) for name in _measures(parts, keys)]
    return parts.groupBy(*keys).agg(*sums).select(*[name for name in parts.columns if name not in RUN_COLUMNS])


def totals_sql(spark: SparkSession, table: str, keys: Sequence[str], order_by: Sequence[str] = ()) -> str:
    """SQL that sums the runs that count, whichever these are when it runs; for a view."""
    df = spark.table(table)
    quoted = {name: storage.quoted(name) for name in df.columns}
    columns = ", ".join(
        quoted[field.name] if field.name in keys else f"CAST(sum({quoted[field.name]}) AS {field.dataType.simpleString()}) AS {quoted[field.name]}"
        for field in df.schema
        if field.name not in RUN_COLUMNS
    )
    order = f" ORDER BY {', '.join(f'{quoted[name]} NULLS LAST' for name in order_by)}" if order_by else ""
    return (
        f"SELECT {columns} FROM {table} p WHERE NOT EXISTS ("
        f"SELECT 1 FROM (SELECT DISTINCT run_stream AS s, run_level AS l, run_first AS f, run_last AS e FROM {table}) w "
        f"WHERE w.s = p.run_stream AND w.l > p.run_level AND w.f <= p.run_first AND p.run_last <= w.e) "
        f"GROUP BY {', '.join(quoted[key] for key in keys)}{order}"
    )


def totals(spark: SparkSession, table: str, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The sums over all batches, per key; the scan prunes to the runs that count."""
    live = counted(runs_of(spark, table))
    df = spark.table(table)
    wanted = F.lit(False)
    for run in live:
        wanted = wanted | (
            (F.col("run_stream") == run.stream) & (F.col("run_level") == run.level) & (F.col("run_first") == run.first) & (F.col("run_last") == run.last)
        )
    summed = _summed(df.where(wanted), keys)
    return summed.orderBy(*[F.col(name).asc_nulls_last() for name in order_by]) if order_by else summed
