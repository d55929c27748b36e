"""Landing of raw frames: per-topic queue files, visible once committed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.frames import FRAME_END


def land(
    frames: DataFrame,
    path: str,
    checkpoint: str | None = None,
    every: str = "60 seconds",
    once: bool = False,
) -> StreamingQuery | None:
    """Write ``topic`` and ``value`` to ``<path>/topic=<name>/`` with new files per trigger.

    A streaming input starts a query (over what is there now with ``once``); a batch
    input is appended and returns None. Read it back with ``read_frames(by_topic=True)``.
    A folder holds what one streaming query landed, or what batches landed, not both.
    Line feeds around a frame are dropped, so exactly one blank line separates frames.
    """
    padded = F.startswith("value", F.lit("\n")) | F.endswith("value", F.lit("\n"))
    value = F.when(padded, F.btrim("value", F.lit("\n"))).otherwise(F.col("value"))
    rows = frames.select(value.alias("value"), "topic")
    if not frames.isStreaming:
        rows.write.mode("append").partitionBy("topic").option("lineSep", FRAME_END).text(path)
        return None
    writer = rows.writeStream.format("text").partitionBy("topic").option("lineSep", FRAME_END)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint or f"{path}/_checkpoint")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def with_topic(frames: DataFrame, topic: str) -> DataFrame:
    """Frames of one topic, labelled for ``land``."""
    return frames.withColumn("topic", F.lit(topic))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint keeps over restarts, so that loads of two streams never collide."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
