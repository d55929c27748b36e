"""Running counts per event-time minute over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import minute_start, minute_text
from millrace.operators import partials
from millrace.operators.incremental import upsert_table
from millrace.plans.gold import count_by_minute
from millrace.streaming.landing import stream_id

# A day of minutes shares a bucket, so late events rewrite the days they belong to.
DAY_BUCKET = "datediff(to_date(substr(minute, 1, 10), 'yyyy/MM/dd'), date'1970-01-01')"


def stream_minute_counts(events: DataFrame, keys: Sequence[str], watermark: str | None = None) -> DataFrame:
    """``count_actions`` per minute of ``dt`` and keys, kept up to date as events arrive.

    Without a watermark, late events correct old minutes for ever and events without a
    time are a group; the state has one row per group. With one (``"2 days"``), state
    older than that is let go: later events for those minutes, and events without a
    time, are left out.
    """
    if watermark:
        # Watermarks need a time with a zone; the time itself goes along and makes the text.
        events = events.withColumn("__time", F.to_timestamp(F.concat(F.col("dt").cast("string"), F.lit("Z"))))
        events = events.withWatermark("__time", watermark)
        minute = F.window("__time", "1 minute").alias("__window")
        counted = events.groupBy(minute, minute_start(F.col("dt")).alias("__minute"), *keys).agg(F.count("*").alias("count_actions"))
        return counted.select(*keys, minute_text(F.col("__minute")).alias("minute"), "count_actions")
    return count_by_minute(events, *keys)


def write_minute_counts(
    counts: DataFrame,
    table: str,
    keys: Sequence[str],
    checkpoint: str,
    every: str | None = None,
    root: str | None = None,
) -> StreamingQuery:
    """Keep a stored table equal to the running counts; each batch sends changed groups only.

    Replacing a group by its new total gives the same table when a batch is repeated.
    """
    session = counts.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_table(
            batch, table, ["minute", *keys], bucket=DAY_BUCKET, null_safe=True, root=root, merge_session=session
        )

    writer = counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def add_minute_counts(
    events: DataFrame, table: str, keys: Sequence[str], checkpoint: str, every: str | None = None, root: str | None = None
) -> StreamingQuery:
    """Counts per minute of ``dt`` and keys of each batch of a stream, added to a table of partial sums.

    No state is kept, and nothing but the batch is read: late events are counted with their old
    minute when the sums are read, and a repeated batch replaces its own counts. Read the table with ``minute_counts``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        run = partials.Run(stream_id(batch.sparkSession, checkpoint), 0, batch_id, batch_id)
        if not partials.is_taken(partials.runs_of(batch.sparkSession, table), f"{run.stream}-{batch_id}"):
            partials.append_run(count_by_minute(batch, *keys), table, run, root)
            partials.fold(batch.sparkSession, table, ["minute", *keys])

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def minute_counts(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """The counts of ``add_minute_counts``, in report order."""
    spark.catalog.refreshTable(table)
    names = ["minute", *keys]
    return partials.totals(spark, table, names, order_by=names).select(*keys, "minute", "count_actions")
