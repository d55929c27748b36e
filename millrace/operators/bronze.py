"""The append-only raw layer: one JSON text column per event, by day and load."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace import storage

from millrace.operators.layout import LOAD_COLUMNS, TABLE_OPTIONS, ensure_layer, load_place, property_of, set_property
from millrace.operators.quality import quality_flags, require_keys
from millrace.operators.sse import parse_sse, split_valid_utf8

BRONZE_COLUMNS = "event STRING, file_name STRING"
LAST_FILE = "millrace.last_file"


@dataclass(frozen=True)
class Topic:
    """A named stream and the top-level keys each of its events must have."""

    name: str
    primary_key: tuple[str, ...] = ("id",)


def bronze_table(topic: str) -> str:
    return storage.quoted(f"bronze.{topic}_raw")


def load_events(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames to the events that belong in bronze: ``event`` and ``file_name``."""
    good, _ = split_valid_utf8(frames)
    return require_keys(parse_sse(good), keys).withColumnRenamed("data", "event")


def _by_topic(frames: DataFrame, topics: Sequence[Topic]) -> tuple[DataFrame, Column]:
    """Parsed events of the listed topics, and the keys each row must have."""
    pairs = [
        part
        for topic in topics
        for part in (F.lit(topic.name), F.array(*[F.lit(k) for k in topic.primary_key]).cast("array<string>"))
    ]
    good, _ = split_valid_utf8(frames.where(F.col("topic").isin([topic.name for topic in topics])))
    return parse_sse(good), F.try_element_at(F.create_map(*pairs), F.col("topic"))


def load_all(frames: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """Events of all topics in one scan, each topic with its own keys.

    ``frames`` has a ``topic`` column; frames of topics that are not listed are left out.
    """
    return require_keys(*_by_topic(frames, topics)).withColumnRenamed("data", "event")


def topic_totals(frames: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """Per topic, the events ``seen`` and the events ``loaded`` by ``load_all``."""
    flagged = quality_flags(*_by_topic(frames, topics))
    return flagged.groupBy("topic").agg(F.count("*").alias("seen"), F.count_if("kept").alias("loaded"))


def create_bronze(spark: SparkSession, topic: str, root: str | None = None) -> str:
    """Create ``bronze.<topic>_raw`` if absent; returns its name."""
    ensure_layer(spark, "bronze", root)
    table = bronze_table(topic)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({BRONZE_COLUMNS}, {LOAD_COLUMNS}) "
        f"USING parquet OPTIONS ({TABLE_OPTIONS}) PARTITIONED BY (load_day, load_id)"
    )
    return table


def append_bronze(events: DataFrame, topic: str, load_id: str | None = None, root: str | None = None) -> str:
    """Write events as one load of ``bronze.<topic>_raw``, creating it if absent.

    Writing a load id again replaces that load, so a repeated attempt does not add rows
    twice. The greatest file name of all loads is kept with the table for the next
    ``last_file_name``. Returns the load id.
    """
    spark = events.sparkSession
    load_id = load_id or uuid.uuid4().hex
    table = create_bronze(spark, topic, root)
    if "file_name" not in events.columns:
        events = events.withColumn("file_name", F.lit(None).cast("string"))
    names = Observation()
    spark.sql(
        f"INSERT OVERWRITE {table} PARTITION ({load_place(spark, table, load_id)}) SELECT event, file_name FROM {{events}}",
        events=events.observe(names, F.max("file_name").alias("last")),
    )
    seen = [name for name in (names.get["last"], property_of(spark, table, LAST_FILE)) if name]
    if seen:
        set_property(spark, table, LAST_FILE, max(seen))
    return load_id


def last_file_name(spark: SparkSession, topic: str) -> str | None:
    """The greatest file name loaded so far, for ``new_frames``; nothing is scanned for it.

    Files of which no event was kept don't count; they are scanned again and yield nothing again.
    """
    return property_of(spark, bronze_table(topic), LAST_FILE)


def explode_json_array(df: DataFrame, column: str) -> DataFrame:
    """One row per element of the JSON array text in ``column``, as ``event`` VARIANT."""
    return df.select(F.explode(F.from_json(column, "array<variant>")).alias("event"))


def relation(
    spark: SparkSession, name: str, models: Mapping[str, DataFrame] | None = None, streaming: bool = False
) -> DataFrame:
    """An upstream relation by name: a model of this run, or a table of the catalog.

    With ``streaming``, a stored table is read as a stream of the files added to it.
    """
    if models and name in models:
        return models[name]
    name = storage.quoted(name)
    return spark.readStream.table(name) if streaming else spark.table(name)
