"""Which events are kept, and counts of those that are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import json as J


def valid_json(parsed: DataFrame) -> DataFrame:
    """Events whose data is exactly one JSON document."""
    return parsed.where(J.is_json_document(F.col("data")))


def require_keys(parsed: DataFrame, keys: Sequence[str] | Column) -> DataFrame:
    """Events that are one JSON object with every key; this includes ``valid_json``."""
    return parsed.where(J.has_keys(F.col("data"), keys))


def quality_flags(parsed: DataFrame, keys: Sequence[str] | Column) -> DataFrame:
    """Adds ``kept``, ``complete`` and ``missing_parts`` (number of absent keys) per event.

    Events that are kept take one parse; only the others are looked at again.
    """
    data = F.col("data")
    flagged = parsed.withColumn("kept", J.has_keys(data, keys))
    flagged = flagged.withColumn("complete", F.when(F.col("kept"), True).otherwise(J.is_json_document(data)))
    absent = F.size(J.missing_keys(data, keys))
    return flagged.withColumn("missing_parts", F.when(F.col("complete") & ~F.col("kept"), absent).otherwise(0))


def quality_measures() -> dict[str, Column]:
    """Aggregates over ``quality_flags``: key parts and events are counted apart."""
    return {
        "seen": F.count("*"),
        "missing_key_parts": F.coalesce(F.sum("missing_parts"), F.lit(0)).cast("bigint"),
        "missing_key_events": F.count_if(F.col("missing_parts") > 0),
        "incomplete": F.count_if(~F.col("complete")),
    }


def severity(counts: DataFrame) -> DataFrame:
    """Adds ``warning`` when anything was left out, else ``info``."""
    bad = (F.col("missing_key_parts") > 0) | (F.col("incomplete") > 0)
    return counts.withColumn("severity", F.when(bad, "warning").otherwise("info"))


def quality_counts(parsed: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Events seen, without a key and incomplete, in one pass; per ``by`` columns if given."""
    measures = [measure.alias(name) for name, measure in quality_measures().items()]
    return severity(quality_flags(parsed, keys).groupBy(*by).agg(*measures))
