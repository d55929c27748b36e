"""Event feeds to report tables on Spark: frames, bronze, silver, gold, export."""

from millrace.functions.json import has_keys, is_json_document
from millrace.operators.bronze import (
    Topic,
    append_bronze,
    explode_json_array,
    last_file_name,
    load_all,
    load_events,
    relation,
    topic_totals,
)
from millrace.operators.incremental import append_load, upsert_table
from millrace.operators.layout import compact_days
from millrace.operators.merge import lookup, merge_batch, merged
from millrace.operators.quality import quality_counts, require_keys, valid_json
from millrace.operators.relational import keyed_anti_join, sort_nulls_last, union_all, upsert, write_bucketed
from millrace.operators.sse import parse_sse, split_valid_utf8
from millrace.plans.gold import gold_human_vs_bot, gold_logs_per_domain_and_min
from millrace.plans.runner import CHANGE_MODELS, Model, ModelRunError, change_models, run_models, sql_model
from millrace.plans.silver import (
    cast_rejects,
    project_events,
    silver_categorize,
    silver_edit,
    silver_log,
    silver_new,
    silver_recentchange,
)
from millrace.session import build_session, configure
from millrace.sinks.csv_export import export_csv, export_layer
from millrace.sources.frames import new_frames, read_frames
from millrace.streaming.counts import add_minute_counts, minute_counts, stream_minute_counts, write_minute_counts
from millrace.streaming.landing import land, with_topic
from millrace.streaming.pipeline import Feed, Pipeline, load_frames, run_continuous, run_once

__all__ = [
    "CHANGE_MODELS",
    "Feed",
    "Model",
    "ModelRunError",
    "Pipeline",
    "Topic",
    "add_minute_counts",
    "append_bronze",
    "append_load",
    "build_session",
    "cast_rejects",
    "change_models",
    "compact_days",
    "configure",
    "explode_json_array",
    "export_csv",
    "export_layer",
    "gold_human_vs_bot",
    "gold_logs_per_domain_and_min",
    "has_keys",
    "is_json_document",
    "keyed_anti_join",
    "land",
    "last_file_name",
    "load_all",
    "load_events",
    "load_frames",
    "lookup",
    "merge_batch",
    "merged",
    "minute_counts",
    "new_frames",
    "parse_sse",
    "project_events",
    "quality_counts",
    "read_frames",
    "relation",
    "require_keys",
    "run_continuous",
    "run_models",
    "run_once",
    "silver_categorize",
    "silver_edit",
    "silver_log",
    "silver_new",
    "silver_recentchange",
    "sort_nulls_last",
    "split_valid_utf8",
    "sql_model",
    "stream_minute_counts",
    "topic_totals",
    "union_all",
    "upsert",
    "upsert_table",
    "valid_json",
    "with_topic",
    "write_bucketed",
    "write_minute_counts",
]
