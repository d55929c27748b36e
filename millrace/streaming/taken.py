"""Which loads of which topics a model has taken in.

Batches of a stream come one after another, so it is enough to keep, per topic and stream, the last
one; a compacted day counts as a batch of the stream ``compacted``, its number being the day. For a
keyed model this is noted with the catalog in two steps: what the next run will hold, before it is
written, and then that it is there. If it was cut off in between and any part of the run is there, it is
written again with the same rows under the same number, and replaces itself. Partial sums need no note: their runs say it.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.layout import COMPACTED, ensure_layer, property_of, set_property
from millrace.operators.partials import batch_of
from millrace.plans.runner import Model

LAYER = "taken_loads"
NOTE = "millrace.taken"
EPOCH = datetime.date(1970, 1, 1)
_NUMBERED = r"^(.+)-([0-9]+)$"

# Per stream the last batch.
Marks = dict[str, int]


@dataclass
class Taken:
    """The last run of a model's table, what it goes up to per topic, and the same of a run that has begun."""

    run: int = -1
    marks: dict[str, Marks] = field(default_factory=dict)
    begun: dict[str, Marks] | None = None


def _name(model: Model) -> str:
    return storage.quoted(f"{LAYER}.{model.layer}_{model.name}")


def taken(spark: SparkSession, model: Model) -> Taken:
    found = property_of(spark, _name(model), NOTE)
    return Taken(**json.loads(found)) if found else Taken()


def note(spark: SparkSession, model: Model, state: Taken, root: str | None = None) -> None:
    ensure_layer(spark, LAYER, root)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(model)} (nothing STRING) USING parquet")
    set_property(spark, _name(model), NOTE, json.dumps(asdict(state)))


def place_of(day: str, load: str) -> tuple[str, int]:
    """Stream and batch of a load's partition."""
    return (COMPACTED, (datetime.date.fromisoformat(day) - EPOCH).days) if load == COMPACTED else batch_of(load)


def marks_of(loads: Iterable[tuple[str, str]]) -> Marks:
    """Per stream the last batch of some (day, load)."""
    marks: Marks = {}
    for day, load in loads:
        stream, batch = place_of(day, load)
        marks[stream] = max(batch, marks.get(stream, batch))
    return marks


def later(marks: Mapping[str, int], after: Mapping[str, int]) -> Marks:
    """The marks of streams that have gone on."""
    return {stream: batch for stream, batch in marks.items() if batch > after.get(stream, -1)}


def rows_between(table: DataFrame, after: Mapping[str, int], upto: Mapping[str, int]) -> DataFrame:
    """Rows of the batches that follow some marks up to others; a condition per stream, on partitions only."""
    matched = F.regexp_extract("load_id", _NUMBERED, 1)
    compacted = F.col("load_id") == COMPACTED
    stream = F.when(compacted, F.lit(COMPACTED)).when(matched != "", matched).otherwise(F.col("load_id"))
    number = F.when(matched != "", F.regexp_extract("load_id", _NUMBERED, 2)).otherwise(F.lit("0")).cast("bigint")
    batch = F.when(compacted, F.datediff("load_day", F.lit(EPOCH)).cast("bigint")).otherwise(number)
    wanted: Column = F.lit(False)
    for name, last in sorted(upto.items()):
        wanted = wanted | ((stream == name) & (batch > after.get(name, -1)) & (batch <= last))
    return table.where(wanted)
