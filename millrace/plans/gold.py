"""Counts per minute for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import minute_start, minute_text
from millrace.operators.relational import sort_nulls_last
from millrace.plans.silver import of_type

# The silver columns that each report reads.
LOGS_COLUMNS = ("type", "domain", "log_action", "dt")
HUMAN_VS_BOT_COLUMNS = ("type", "bot", "dt")


def count_by_minute(df: DataFrame, *keys: str) -> DataFrame:
    """``count_actions`` per minute of ``dt`` and the given keys; NULLs are groups too.

    Groups are formed on the truncated time and get their text afterwards, so the text
    is made once per group and not once per event.
    """
    grouped = df.groupBy(minute_start(F.col("dt")).alias("__minute"), *keys)
    counted = grouped.agg(F.count("*").alias("count_actions"))
    return counted.select(*keys, minute_text(F.col("__minute")).alias("minute"), "count_actions")


def count_by_domain_action_minute(log: DataFrame) -> DataFrame:
    return count_by_minute(log, "domain", "log_action")


def count_by_minute_bool(actions: DataFrame) -> DataFrame:
    return count_by_minute(actions, "bot").select("minute", "bot", "count_actions")


def gold_logs_per_domain_and_min(silver: DataFrame) -> DataFrame:
    """Log events per domain, action and minute, in report order."""
    counts = count_by_domain_action_minute(of_type(silver, "log"))
    return sort_nulls_last(counts, "minute", "domain", "log_action")


def gold_human_vs_bot(silver: DataFrame) -> DataFrame:
    """Page creations and edits per minute, by humans and by bots, in report order.

    Creations and edits never share a row, so their bag union is one filter over one
    scan of silver instead of two scans.
    """
    actions = silver.where(F.col("type").isin("new", "edit"))
    return sort_nulls_last(count_by_minute_bool(actions), "minute", "bot")
