"""One query per operator, each over the whole tables of a test-data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import feed
from millrace.functions import json as J
from millrace.functions import text as X
from millrace.operators import bronze as B
from millrace.operators import incremental as I
from millrace.operators import quality as Q
from millrace.operators import relational as R
from millrace.operators import sse as S
from millrace.plans import gold as G
from millrace.plans import silver as V
from millrace.operators.layout import without_load
from millrace.operators.merge import merge_batch, merged
from millrace.operators.partials import partial_table
from millrace.plans.runner import Model, change_models, run_models, sql_model
from millrace.session import configure, scratch_dir, shared_dir
from millrace.sinks.csv_export import CSV_OPTIONS, export_csv
from millrace.sources import frames as A
from millrace.streaming import counts as N
from millrace.streaming.landing import land, with_topic
from millrace.streaming.pipeline import Feed, run_continuous, run_once

KEYS = ["id"]
PRODUCERS = 8
# The feed arrives in two parts: what happened before this time, and the rest.
SECOND_START = "timestamp_ntz'2024-01-16 00:00:00'"
FIRST_PART, SECOND_PART = f"ts < {SECOND_START}", f"ts >= {SECOND_START}"
FIRST_STAMP, SECOND_STAMP = 1700000000, 1700000060
# A file that comes with the second part under a name before all others.
LATE_PART, LATE_STAMP = f"ts >= {SECOND_START} AND event_id % 10 = 0", 1600000000
# The keys of each topic when every event type is a topic of its own.
TOPICS = (
    B.Topic("click", ("id",)),
    B.Topic("signup", ("id", "patrolled")),
    B.Topic("view", ("id", "comment")),
    B.Topic("error", ("id", "log_params")),
    B.Topic("purchase", ()),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed, from at least so many producers as one would have: one file of events is one task otherwise."""
    events = table(spark, sf_dir, "events")
    return feed.frames(events.repartition(max(PRODUCERS, events.rdd.getNumPartitions())))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_sse(all_frames(spark, sf_dir)).select("data")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.load_events(all_frames(spark, sf_dir), KEYS).select("event")


def silver(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    return V.silver_recentchange(bronze(spark, sf_dir), only=only)


def unique(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


def warehouse(spark: SparkSession) -> str:
    return f"{shared_dir(configure(spark))}/millrace/warehouse"


def write_part(spark: SparkSession, sf_dir: str, path: str, second: bool) -> None:
    frames = all_frames(spark, sf_dir)
    part = frames.where(SECOND_PART if second else FIRST_PART)
    feed.write_queue(part, path, SECOND_STAMP if second else FIRST_STAMP)


def write_late(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The second part in two files, of which one has a smaller name than the files before."""
    frames = all_frames(spark, sf_dir)
    feed.write_queue(frames.where(LATE_PART), path, LATE_STAMP)
    feed.write_queue(frames.where(f"{SECOND_PART} AND NOT ({LATE_PART})"), path, SECOND_STAMP)


def queue(spark: SparkSession, sf_dir: str) -> str:
    """A fresh folder with the whole feed as queue files."""
    path = scratch_dir(spark, "queue")
    write_part(spark, sf_dir, path, second=False)
    write_part(spark, sf_dir, path, second=True)
    return path


# Sources


def src_sse_frames(spark, sf_dir):
    return A.read_frames(spark, queue(spark, sf_dir)).select("value")


def src_new_files_since(spark, sf_dir):
    path = scratch_dir(spark, "queue")
    write_part(spark, sf_dir, path, second=False)
    topic = unique("change")
    B.append_bronze(B.load_events(A.new_frames(spark, path), KEYS), topic, root=warehouse(spark))
    mark = B.last_file_name(spark, topic)
    write_part(spark, sf_dir, path, second=True)
    return A.new_frames(spark, path, mark).select("value")


def src_relation(spark, sf_dir):
    topic = unique("change")
    B.append_bronze(bronze(spark, sf_dir), topic, root=warehouse(spark))
    return B.relation(spark, f"bronze.{topic}_raw").select("event")


# Frames to bronze


def sse_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


def utf8_quarantine(spark, sf_dir):
    good, bad = S.split_valid_utf8(feed.undecodable(all_frames(spark, sf_dir)))
    labelled = [part.select("event_id", F.lit(ok).alias("decodable")) for part, ok in ((good, True), (bad, False))]
    return R.union_all(*labelled)


def json_valid_filter(spark, sf_dir):
    return Q.valid_json(parsed(spark, sf_dir))


def pk_presence_filter(spark, sf_dir):
    return Q.require_keys(parsed(spark, sf_dir), ["id", "comment"])


def load_quality_counts(spark, sf_dir):
    return Q.quality_counts(parsed(spark, sf_dir), ["id", "patrolled"])


def json_array_explode(spark, sf_dir):
    numbers = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda n: n < F.col("event_id") % 4)
    elements = F.transform(numbers, lambda n: F.struct(F.col("event_id").alias("id"), n.alias("n")))
    arrays = table(spark, sf_dir, "events").select(F.to_json(elements).alias("text"))
    return B.explode_json_array(arrays, "text").select(F.to_json("event").alias("event"))


def bronze_append(spark, sf_dir):
    topic, root = unique("change"), warehouse(spark)
    frames = all_frames(spark, sf_dir)
    parts = {"first": frames.where(FIRST_PART), "second": frames.where(SECOND_PART)}
    # The second load is attempted twice, as after a failure; it counts once.
    for load_id in ("first", "second", "second"):
        B.append_bronze(B.load_events(parts[load_id], KEYS), topic, load_id, root)
    return spark.table(B.bronze_table(topic)).select("event", "load_id")


def multi_topic_load(spark, sf_dir):
    frames = all_frames(spark, sf_dir).withColumn("topic", F.col("event_type"))
    return B.topic_totals(frames, TOPICS)


def load_all(spark, sf_dir):
    frames = all_frames(spark, sf_dir).withColumn("topic", F.col("event_type"))
    return B.load_all(frames, TOPICS).select("topic", "event")


# Scalar functions


def json_path_bigint(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "revision_new", "revision_old", "length_new", "length_old"))


def json_path_boolean(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "bot", "minor", "patrolled"))


def json_path_timestamp(spark, sf_dir):
    event = F.col("event")
    return bronze(spark, sf_dir).select(
        J.bigint_at(event, "id").alias("id"), J.timestamp_at(event, "meta.dt").alias("dt")
    )


def json_extract_string(spark, sf_dir):
    return silver(spark, sf_dir, tuple(name for name, _, kind in V.CHANGE_COLUMNS if kind == "string"))


def cast_rejects(spark, sf_dir):
    return V.cast_rejects(bronze(spark, sf_dir))


def json_subdocument(spark, sf_dir):
    event = F.col("event")
    return bronze(spark, sf_dir).select(
        J.bigint_at(event, "id").alias("id"), F.to_json(J.variant_at(event, "log_params")).alias("log_params")
    )


def json_path_json(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "log_params")).select("id", *V.log_param_columns(F.col("log_params")))


def project_rename(spark, sf_dir):
    base = silver(spark, sf_dir, ("id", "title", "domain", "length_new"))
    return base.select("id", "title", "domain", F.col("length_new").alias("length"))


def arith_difference(spark, sf_dir):
    base = silver(spark, sf_dir, ("id", "revision_new", "revision_old", "length_new", "length_old"))
    return base.select(
        "id",
        X.difference(F.col("revision_new"), F.col("revision_old")).alias("revision_global_offset"),
        X.difference(F.col("length_new"), F.col("length_old")).alias("length_difference"),
    )


def regexp_extract_link(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "comment")).select("id", X.first_link(F.col("comment")).alias("object"))


def case_contains(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "comment")).select("id", X.action_type(F.col("comment")).alias("action_type_en"))


def minute_format(spark, sf_dir):
    return silver(spark, sf_dir, ("id", "dt")).select("id", X.minute_text(F.col("dt")).alias("minute"))


# Filters, joins, aggregates, order, sets


def filter_event_type(spark, sf_dir):
    return V.of_type(silver(spark, sf_dir, ("id", "type", "user")), "categorize")


def keyed_anti_join(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'")
    batch = recent.select(F.col("o_orderkey").alias("l_orderkey"))
    # The target lies in buckets of its key, so the join doesn't move it.
    name, buckets = f"silver.{unique('lineitem')}", 16
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    R.write_bucketed(lines, name, ["l_orderkey"], buckets, warehouse(spark))
    return R.keyed_anti_join(spark.table(name), batch, ["l_orderkey"], buckets=buckets)


def count_by_domain_action_minute(spark, sf_dir):
    return G.count_by_domain_action_minute(V.of_type(silver(spark, sf_dir, G.LOGS_COLUMNS), "log"))


def new_and_edit_actions(spark, sf_dir):
    base = silver(spark, sf_dir, G.HUMAN_VS_BOT_COLUMNS)
    return R.union_all(*[V.of_type(base, kind).select("bot", "dt") for kind in ("edit", "new")])


def count_by_minute_bool(spark, sf_dir):
    return G.count_by_minute_bool(new_and_edit_actions(spark, sf_dir))


def sort_multi_key(spark, sf_dir):
    base = silver(spark, sf_dir, ("id", "log_action", "dt"))
    rows = base.select("log_action", X.minute_text(F.col("dt")).alias("minute"), "id")
    return R.sort_nulls_last(rows, "minute", "log_action", "id")


def union_all(spark, sf_dir):
    return new_and_edit_actions(spark, sf_dir).select(X.minute_text(F.col("dt")).alias("minute"), "bot")


# Models


def silver_recentchange(spark, sf_dir):
    return silver(spark, sf_dir).withColumn("log_params", F.to_json("log_params"))


def silver_new(spark, sf_dir):
    return V.silver_new(silver(spark, sf_dir))


def silver_edit(spark, sf_dir):
    return V.silver_edit(silver(spark, sf_dir))


def silver_categorize(spark, sf_dir):
    return V.silver_categorize(silver(spark, sf_dir))


def silver_log(spark, sf_dir):
    return V.silver_log(silver(spark, sf_dir))


def gold_logs_per_domain_and_min(spark, sf_dir):
    return G.gold_logs_per_domain_and_min(silver(spark, sf_dir, G.LOGS_COLUMNS))


def gold_human_vs_bot(spark, sf_dir):
    return G.gold_human_vs_bot(silver(spark, sf_dir, G.HUMAN_VS_BOT_COLUMNS))


# Materialization


def incremental_delete_insert(spark, sf_dir):
    name, root = f"silver.{unique('orders')}", warehouse(spark)
    orders = table(spark, sf_dir, "orders")
    changed = orders.where("o_orderdate >= timestamp_ntz'2001-01-01 00:00:00'").withColumn("o_orderstatus", F.lit("R"))
    added = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    # The added rows come twice in the batch, and both copies stay.
    batch = R.union_all(changed, added, added)
    for rows in (orders, batch):
        merge_batch(rows, name, ["o_orderkey"], root=root)
    return merged(spark, name)


def incremental_append(spark, sf_dir):
    name, root = f"silver.{unique('change')}", warehouse(spark)
    frames = all_frames(spark, sf_dir)
    for load_id, part in (("first", FIRST_PART), ("second", SECOND_PART)):
        rows = V.silver_recentchange(B.load_events(frames.where(part), KEYS))
        I.append_load(rows, name, load_id, root)
    return spark.table(name).withColumn("log_params", F.to_json("log_params")).drop("load_day")


def model_run(spark, sf_dir, extra=()):
    """Bronze and silver stored, and the models of the changes over them; their names begin with the topic."""
    topic, root = unique("change"), warehouse(spark)
    B.append_bronze(bronze(spark, sf_dir), topic, root=root)
    raw = B.relation(spark, f"bronze.{topic}_raw")
    I.append_load(V.silver_recentchange(raw), f"silver.{topic}", "first", root)
    extra = [model(topic) for model in extra]
    inputs, stored = {topic: without_load(spark.table(f"silver.{topic}"))}, {topic: f"silver.{topic}"}
    return topic, run_models(spark, [*extra, *change_models(topic)], inputs, root=root, stored=stored)


def log_actions_model(topic):
    text = f"SELECT log_action, sum(count_actions) AS count_actions FROM {{{topic}_logs_per_domain_and_min}} GROUP BY log_action"
    return Model(f"{topic}_log_actions", "gold", text, materialized="table")


def run_all_models(spark, sf_dir):
    """Rows of each relation, read from the catalog by its name, and the table's own sum."""
    topic, results = model_run(spark, sf_dir, [log_actions_model])
    counts = []
    for name in results:
        relation = B.relation(spark, name)
        total = F.sum("count_actions") if "count_actions" in relation.columns else F.lit(None)
        model = F.lit(name.split(".")[1].removeprefix(f"{topic}_")).alias("model")
        counts.append(relation.agg(F.count("*").alias("n"), total.cast("bigint").alias("total")).select(model, "n", "total"))
    return R.union_all(*counts)


def both_reports(spark, folder, topic):
    """Both gold reports as they are in the exported files."""
    logs, bots = f"{folder}/{topic}_logs_per_domain_and_min.csv", f"{folder}/{topic}_human_vs_bot_new_and_edit_actions.csv"
    logs = spark.read.schema("domain STRING, log_action STRING, minute STRING, count_actions BIGINT").options(**CSV_OPTIONS).csv(logs)
    bots = spark.read.schema("minute STRING, bot BOOLEAN, count_actions BIGINT").options(**CSV_OPTIONS).csv(bots)
    both = logs.withColumn("report", F.lit("logs")).unionByName(bots.withColumn("report", F.lit("bots")), allowMissingColumns=True)
    return both.select("report", "minute", "domain", "log_action", "bot", "count_actions")


def user_sql_model(spark, sf_dir):
    text = """
        SELECT user, count(*) AS edits, sum(length_difference) AS growth, max(dt) AS last_dt
        FROM {recentchange_edit} GROUP BY user
    """
    return sql_model(spark, text, {"recentchange_edit": V.silver_edit(silver(spark, sf_dir))})


# Sinks


def land_raw_frames(spark, sf_dir):
    path, landed = queue(spark, sf_dir), scratch_dir(spark, "landed")
    stream = with_topic(A.read_frames(spark, path, streaming=True), "recentchange")
    land(stream, landed, once=True).awaitTermination()
    return A.read_frames(spark, landed, by_topic=True).select("topic", "value")


def gold_csv_export(spark, sf_dir):
    topic, results = model_run(spark, sf_dir)
    folder = scratch_dir(spark, "export")
    export_csv({name: df for name, df in results.items() if name.startswith("gold.")}, folder)
    return both_reports(spark, folder, topic)


# Streams


def stream_once(spark, sf_dir):
    topic, folder = unique("change"), scratch_dir(spark, "export")
    feeds = Feed(B.Topic(topic), queue(spark, sf_dir), sort_by=("type",))
    models = change_models(topic, partial=True)
    run_once(spark, feeds, scratch_dir(spark, "checkpoint"), models=models, csv_dir=folder, root=warehouse(spark))
    return both_reports(spark, folder, topic)


def stream_continuous(spark, sf_dir):
    topic, folder, path = unique("change"), scratch_dir(spark, "export"), scratch_dir(spark, "queue")
    write_part(spark, sf_dir, path, second=False)
    settings = {"models": change_models(topic, partial=True), "csv_dir": folder, "export_every": 0, "root": warehouse(spark)}
    running = run_continuous(spark, Feed(B.Topic(topic), path), scratch_dir(spark, "checkpoint"), every=0.1, **settings)
    try:
        write_late(spark, sf_dir, path)
        running.wait()
    finally:
        running.stop()
    return both_reports(spark, folder, topic)


def multi_topic_cycle(spark, sf_dir):
    """Two topics loaded side by side, then one model over both and over their bronze."""
    topics, feeds = (unique("log"), unique("other")), []
    frames = all_frames(spark, sf_dir)
    for topic, rows in zip(topics, (frames.where("event_type = 'error'"), frames.where("event_type <> 'error'")), strict=True):
        path = scratch_dir(spark, "queue")
        feed.write_queue(rows, path, FIRST_STAMP)
        feeds.append(Feed(B.Topic(topic), path))
    logs, others = topics
    text = (
        f"SELECT domain, count(*) AS events, count(log_action) AS log_events FROM (SELECT domain, log_action FROM {{{logs}}} "
        f"UNION ALL SELECT domain, log_action FROM {{{others}}}) GROUP BY domain "
        f"UNION ALL SELECT 'bronze', count(*), (SELECT count(*) FROM {{{logs}_raw}}) FROM {{{others}_raw}}"
    )
    model = Model(unique("domains"), "gold", text)
    pipeline = run_once(spark, feeds, scratch_dir(spark, "checkpoint"), models=[model], root=warehouse(spark))
    return pipeline.results[model.full_name]


def stream_checkpoint(spark, sf_dir):
    topic, path, checkpoint = B.Topic(unique("change")), scratch_dir(spark, "queue"), scratch_dir(spark, "checkpoint")
    write_part(spark, sf_dir, path, second=False)
    run_once(spark, Feed(topic, path), checkpoint, root=warehouse(spark))
    write_late(spark, sf_dir, path)
    run_once(spark, Feed(topic, path), checkpoint, root=warehouse(spark))
    loads = spark.table(B.bronze_table(topic.name)).groupBy("load_id").agg(F.count("*").alias("events"))
    return loads.select(F.substring_index("load_id", "-", -1).cast("int").alias("batch"), "events")


def stream_minute_counts(spark, sf_dir):
    path, checkpoint = scratch_dir(spark, "queue"), scratch_dir(spark, "checkpoint")
    keys, name = ["domain", "log_action"], partial_table(unique("log_counts"))
    # The counts go on after a restart from where they were.
    for second in (False, True):
        write_part(spark, sf_dir, path, second)
        changes = V.silver_recentchange(B.load_events(A.read_frames(spark, path, streaming=True), KEYS))
        N.add_minute_counts(V.of_type(changes, "log"), name, keys, checkpoint, root=warehouse(spark)).awaitTermination()
    return N.minute_counts(spark, name, keys)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        src_sse_frames,
        src_new_files_since,
        src_relation,
        sse_parse,
        utf8_quarantine,
        json_valid_filter,
        pk_presence_filter,
        load_quality_counts,
        json_array_explode,
        bronze_append,
        multi_topic_load,
        load_all,
        multi_topic_cycle,
        json_path_bigint,
        json_path_boolean,
        json_path_timestamp,
        json_extract_string,
        cast_rejects,
        json_subdocument,
        json_path_json,
        project_rename,
        arith_difference,
        regexp_extract_link,
        case_contains,
        minute_format,
        filter_event_type,
        keyed_anti_join,
        count_by_domain_action_minute,
        count_by_minute_bool,
        sort_multi_key,
        union_all,
        silver_recentchange,
        silver_new,
        silver_edit,
        silver_categorize,
        silver_log,
        gold_logs_per_domain_and_min,
        gold_human_vs_bot,
        incremental_delete_insert,
        incremental_append,
        user_sql_model,
        land_raw_frames,
        gold_csv_export,
        stream_once,
        stream_continuous,
        stream_checkpoint,
        stream_minute_counts,
    )
}
QUERIES["run_models"] = run_all_models
