import datetime
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import bronze as B
from millrace.operators import incremental as I
from millrace.plans import gold as G
from millrace.plans import silver as V
from millrace.plans.runner import Model, ModelRunError, change_models
from millrace.sinks.csv_export import export_layer
from millrace.sources import frames as A
from millrace.streaming import counts as N
from millrace.streaming.landing import land, with_topic
from millrace.streaming.pipeline import Feed, Pipeline, load_frames, run_continuous, run_once


def frame(event_id, kind="edit", minute=0, **fields):
    meta = {"domain": "d", "dt": f"2024-01-01T00:{minute:02d}:07Z"}
    return "id: 1\ndata: " + json.dumps({"id": event_id, "type": kind, "meta": meta, **fields}) + "\n\n"


FRAMES = [frame(i, ["edit", "new", "log"][i % 3], i % 4, bot=i % 2 == 0, log_action="a") for i in range(24)]
DEFECTS = ["data: {cut\n\n", 'data: {"other_key": "value"}\n\n', ": comment\n\n"]


@pytest.fixture
def topic():
    return B.Topic(f"t{uuid.uuid4().hex}")


@pytest.fixture(autouse=True)
def no_reports_of_other_tests(spark):
    spark.sql("DROP DATABASE IF EXISTS gold CASCADE")


def put(folder, name, frames):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("".join(frames).encode())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def batch_silver(spark, folder):
    return V.silver_recentchange(B.load_events(A.read_frames(spark, str(folder)), ["id"]))


def silver_table(spark, topic):
    return spark.table(f"silver.{topic.name}")


@pytest.mark.parametrize("cuts", [(27,), (5, 9, 27), (26, 27)])
def test_stream_equals_batch_for_any_split_into_files(spark, tmp_path, topic, cuts):
    sent, start = FRAMES[::-1] + DEFECTS, 0
    for number, end in enumerate(cuts):
        put(tmp_path / "q", f"{number}.bin", sent[start:end])
        start = end
    counts = []
    run_once(
        spark,
        Feed(topic, str(tmp_path / "q"), sort_by=("type",)),
        str(tmp_path / "c"),
        report=lambda name, found: counts.append(found),
        maxFilesPerTrigger=1,
    )
    expected = batch_silver(spark, tmp_path / "q")
    actual = silver_table(spark, topic)
    assert rows(G.gold_human_vs_bot(actual)) == rows(G.gold_human_vs_bot(expected))
    assert rows(G.gold_logs_per_domain_and_min(actual)) == rows(G.gold_logs_per_domain_and_min(expected))
    assert actual.count() == 24
    assert [sum(c[k] for c in counts) for k in ("seen", "missing_key_parts", "incomplete")] == [26, 1, 1]


def test_restart_loads_new_files_only(spark, tmp_path, topic):
    put(tmp_path / "q", "2.bin", FRAMES[:10])
    run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"))
    run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"))
    # A file with a smaller name that comes late is new too.
    put(tmp_path / "q", "1.bin", FRAMES[10:])
    run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"))
    loads = silver_table(spark, topic).groupBy("load_id").count().orderBy("load_id").collect()
    assert [r["count"] for r in loads] == [10, 14]


def test_a_batch_that_failed_is_loaded_once(spark, tmp_path, topic):
    """Typing fails after bronze was written; the next run repeats the batch."""
    put(tmp_path / "q", "1.bin", FRAMES)

    def broken(bronze):
        raise ValueError("typing is broken")

    with pytest.raises(Exception, match="typing is broken"):
        run_once(spark, Feed(topic, str(tmp_path / "q"), broken), str(tmp_path / "c"))
    run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"))
    assert silver_table(spark, topic).count() == 24
    assert spark.table(B.bronze_table(topic.name)).count() == 24


def test_two_streams_into_one_table_do_not_replace_each_other(spark, tmp_path, topic):
    put(tmp_path / "q1", "1.bin", FRAMES[:5])
    put(tmp_path / "q2", "1.bin", FRAMES[5:])
    for n in (1, 2):
        run_once(spark, Feed(topic, str(tmp_path / f"q{n}")), str(tmp_path / f"c{n}"))
    assert silver_table(spark, topic).count() == 24


def test_undecodable_frames_are_counted_while_loading(spark, tmp_path, topic):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.bin").write_bytes(b'data: {"id": 1}\n\ndata: \xff\xfe\n\ndata: {"id": 2}\n\n')
    counts = load_frames(A.read_frames(spark, str(tmp_path / "q")), topic, "one")
    assert counts == {
        "seen": 2,
        "missing_key_parts": 0,
        "missing_key_events": 0,
        "incomplete": 0,
        "undecodable": 1,
        "undecodable_file": "1.bin",
    }


def test_a_load_of_bad_events_only(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", DEFECTS)
    run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"))
    assert spark.table(B.bronze_table(topic.name)).count() == 0


def test_models_run_again_when_they_failed(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES[:4])
    works = []

    def model(silver):
        if not works:
            raise ValueError("model is broken")
        return silver

    models = [Model(f"all_{topic.name}", "gold", model, (topic.name,), "incremental", ("id",))]
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), models=models)
    with pytest.raises(ModelRunError, match="model is broken"):
        pipeline.cycle()
    works.append(True)
    put(tmp_path / "q", "2.bin", FRAMES[4:9])
    pipeline.cycle()
    assert pipeline.results[models[0].full_name].count() == 9


def test_incremental_models_get_the_new_load_only(spark, tmp_path, topic):
    sizes = []

    def model(silver):
        sizes.append(silver.count())
        return silver

    models = [Model(f"all_{topic.name}", "gold", model, (topic.name,), "incremental", ("id",))]
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), models=models)
    for n, part in enumerate((FRAMES[:10], FRAMES[10:13], [])):
        put(tmp_path / "q", f"{n}.bin", part) if part else None
        pipeline.cycle()
    assert sizes == [10, 3]
    assert pipeline.results[models[0].full_name].count() == 13


def test_loads_of_a_failed_model_reach_it_in_a_later_run(spark, tmp_path, topic):
    works, sizes = [True], []

    def model(silver):
        if not works:
            raise ValueError("model is broken")
        sizes.append(silver.count())
        return silver

    models = [Model(f"all_{topic.name}", "gold", model, (topic.name,), "incremental", ("id",))]
    feed, checkpoint = Feed(topic, str(tmp_path / "q")), str(tmp_path / "c")
    put(tmp_path / "q", "1.bin", FRAMES[:4])
    run_once(spark, feed, checkpoint, models=models)
    works.clear()
    put(tmp_path / "q", "2.bin", FRAMES[4:9])
    with pytest.raises(ModelRunError, match="model is broken"):
        run_once(spark, feed, checkpoint, models=models)
    works.append(True)
    put(tmp_path / "q", "3.bin", FRAMES[9:11])
    assert run_once(spark, feed, checkpoint, models=models).results[models[0].full_name].count() == 11
    assert sizes == [4, 7]
    # A model that is added later gets the history, the other one nothing again, also after compaction.
    late = Model(f"late_{topic.name}", "gold", lambda silver: silver, (topic.name,), "incremental", ("id",))
    pipeline = run_once(spark, feed, checkpoint, models=[*models, late])
    assert pipeline.results[late.full_name].count() == 11
    pipeline.compact(datetime.date.today() + datetime.timedelta(days=2))
    put(tmp_path / "q", "4.bin", FRAMES[11:12])
    pipeline = run_once(spark, feed, checkpoint, models=[*models, late])
    assert [pipeline.results[m.full_name].count() for m in (*models, late)] == [12, 12]
    assert sizes == [4, 7, 0, 1]


def test_any_topic_needs_no_type(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", ['data: {"id":1,"order":{"paid":true}}\n\n'])
    columns = [("id", "id", "bigint"), ("paid", "order.paid", "boolean")]
    run_once(spark, Feed(topic, str(tmp_path / "q"), lambda bronze: V.project_events(bronze, columns)), str(tmp_path / "c"))
    assert rows(silver_table(spark, topic).select("id", "paid")) == [(1, True)]


def test_one_cycle_over_two_topics(spark, tmp_path):
    topics = [B.Topic(f"t{uuid.uuid4().hex}") for _ in range(2)]
    for topic, part in zip(topics, (FRAMES[:5], FRAMES[5:12]), strict=True):
        put(tmp_path / topic.name, "1.bin", part)
    text = f"SELECT count(*) AS n FROM (SELECT id FROM {{{topics[0].name}}} UNION ALL SELECT id FROM {{{topics[1].name}}})"
    name = f"both_{uuid.uuid4().hex}"
    feeds = [Feed(topic, str(tmp_path / topic.name)) for topic in topics]
    run_once(spark, feeds, str(tmp_path / "c"), models=[Model(name, "gold", text)], csv_dir=str(tmp_path / "csv"))
    assert (tmp_path / "csv" / f"{name}.csv").read_text() == "n\n12\n"
    assert spark.newSession().table(f"gold.{name}").first().n == 12
    assert export_layer(spark, str(tmp_path / "layer"), "gold")[f"gold.{name}"].endswith(f"{name}.csv")


def test_continuous_load_with_export(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES[:12])
    settings = {"models": change_models(topic.name), "csv_dir": str(tmp_path / "csv"), "export_every": 0}
    running = run_continuous(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), every=0.1, **settings)
    name = f"{topic.name}_human_vs_bot_new_and_edit_actions.csv"
    try:
        running.wait()
        first = (tmp_path / "csv" / name).read_text()
        put(tmp_path / "q", "2.bin", FRAMES[12:])
        running.wait()
        second = (tmp_path / "csv" / name).read_text()
    finally:
        running.stop()
    total = lambda text: sum(int(line.split(";")[2]) for line in text.splitlines()[1:])
    assert first.startswith("minute;bot;count_actions\n2024/01/01 00:00;")
    assert (total(first), total(second)) == (8, 16)


def test_an_idle_pipeline_exports_when_it_is_due(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES)
    name = f"{topic.name}_logs_per_domain_and_min.csv"
    settings = {"models": change_models(topic.name), "csv_dir": str(tmp_path / "csv")}
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), export_every=2, **settings)
    pipeline.cycle()
    (tmp_path / "csv" / name).unlink()
    pipeline.cycle()
    assert not (tmp_path / "csv" / name).exists()
    time.sleep(2)
    pipeline.cycle()
    assert (tmp_path / "csv" / name).exists()


def test_late_events_correct_old_minutes(spark, tmp_path):
    table, keys = f"gold.t{uuid.uuid4().hex}", ["domain", "log_action"]
    late = [frame(100, "log", 0, log_action=None), frame(101, "log", 0, log_action=None)]
    no_time = ['data: {"id":1,"type":"log","log_action":"a"}\n\n'] * 2
    for number, sent in enumerate([FRAMES[:12], FRAMES[12:], late + no_time, late[:1] + no_time[:1]]):
        put(tmp_path / "q", f"{number}.bin", sent)
        frames = A.read_frames(spark, str(tmp_path / "q"), streaming=True)
        logs = V.of_type(V.silver_recentchange(B.load_events(frames, ["id"])), "log")
        counts = N.stream_minute_counts(logs, keys)
        N.write_minute_counts(counts, table, keys, str(tmp_path / "c")).awaitTermination()
        expected = G.gold_logs_per_domain_and_min(batch_silver(spark, tmp_path / "q"))
        assert rows(spark.table(table).drop(I.BUCKET).select(expected.columns)) == rows(expected)


def test_a_watermark_bounds_the_counts(spark, tmp_path):
    put(tmp_path / "q", "1.bin", FRAMES)
    frames = A.read_frames(spark, str(tmp_path / "q"), streaming=True)
    logs = V.of_type(V.silver_recentchange(B.load_events(frames, ["id"])), "log")
    counts = N.stream_minute_counts(logs, ["log_action"], watermark="1 day")
    table = f"gold.t{uuid.uuid4().hex}"
    N.write_minute_counts(counts, table, ["log_action"], str(tmp_path / "c")).awaitTermination()
    assert spark.table(table).agg(F.sum("count_actions")).first()[0] == 8


def test_landed_frames_read_back_as_they_were(spark, tmp_path):
    sent = FRAMES + DEFECTS + ["data: a\ndata: b\r\n\n"]
    put(tmp_path / "q", "1.bin", sent[:9])
    put(tmp_path / "q", "2.bin", sent[9:])
    source = with_topic(A.read_frames(spark, str(tmp_path / "q"), streaming=True, maxFilesPerTrigger=1), "123")
    land(source, str(tmp_path / "landed"), once=True).awaitTermination()
    landed = A.read_frames(spark, str(tmp_path / "landed"), by_topic=True)
    expected = [("123", text.removesuffix("\n\n")) for text in sent]
    assert rows(landed.select("topic", "value")) == sorted(expected, key=str)


def test_batches_can_be_landed(spark, tmp_path):
    frames = spark.createDataFrame([("a", "data: 1"), ("b", "data: 2\ndata: 3")], "topic STRING, value STRING")
    for _ in range(2):
        assert land(frames, str(tmp_path / "landed")) is None
    landed = A.read_frames(spark, str(tmp_path / "landed"), by_topic=True).select("topic", "value")
    assert rows(landed) == rows(frames.union(frames))
