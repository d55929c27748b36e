"""Partial sums, and pipelines whose reports are made of them."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import partials as P
from millrace.operators.bronze import Topic
from millrace.plans import gold as G
from millrace.plans.runner import Model, ModelRunError, change_models, partial_sums_table
from millrace.streaming import pipeline as pipelines
from millrace.streaming.pipeline import Feed, Pipeline, run_once
from millrace.streaming.taken import Taken, note, rows_between, taken

TODAY = datetime.datetime.now(datetime.timezone.utc).date()


@pytest.fixture
def topic():
    return Topic(f"t{uuid.uuid4().hex[:12]}")


@pytest.fixture(autouse=True)
def no_reports_of_other_tests(spark):
    spark.sql("DROP DATABASE IF EXISTS gold CASCADE")


def frame(event_id, kind="edit", minute=0, **fields):
    meta = {"domain": "d", "dt": f"2024-01-01T00:{minute:02d}:07Z"}
    return "data: " + json.dumps({"id": event_id, "type": kind, "meta": meta, **fields}) + "\n\n"


FRAMES = [frame(i, ["edit", "new", "log"][i % 3], i % 4, bot=[True, False, None][i % 7 % 3], log_action="a") for i in range(24)]


def put(folder, name, frames):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("".join(frames).encode())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def reports(topic):
    return [f"gold.{topic.name}_logs_per_domain_and_min", f"gold.{topic.name}_human_vs_bot_new_and_edit_actions"]


def same_as_batch(spark, topic):
    silver = spark.table(f"silver.{topic.name}")
    logs, bots = (spark.table(name) for name in reports(topic))
    want = G.gold_logs_per_domain_and_min(silver), G.gold_human_vs_bot(silver)
    assert [tuple(r) for r in logs.collect()] == [tuple(r) for r in want[0].select(logs.columns).collect()]
    assert [tuple(r) for r in bots.collect()] == [tuple(r) for r in want[1].select(bots.columns).collect()]


def test_runs_are_summed_folded_and_replaced(spark):
    table = P.partial_table(f"s{uuid.uuid4().hex[:8]}")
    sums = lambda *data: spark.createDataFrame(data, "k STRING, n BIGINT")
    for batch in range(11):
        P.append_run(sums(("a", 1), (None, 2)), table, P.Run("x", 0, batch, batch))
        P.fold(spark, table, ["k"], fan=3)
        P.append_run(sums(("a", 1), (None, 2)), table, P.Run("x", 0, batch, batch))  # the same again
        assert rows(P.totals(spark, table, ["k"])) == [("a", batch + 1), (None, 2 * batch + 2)]
        assert rows(spark.sql(P.totals_sql(spark, table, ["k"]))) == [("a", batch + 1), (None, 2 * batch + 2)]
        assert len(P.counted(P.runs_of(spark, table))) <= 6
    P.append_run(sums(("b", 5)), table, P.Run("y", 0, 0, 0))
    assert rows(P.totals(spark, table, ["k"])) == [("a", 11), ("b", 5), (None, 22)]
    assert P.is_taken(P.runs_of(spark, table), "x-000000000003") and not P.is_taken(P.runs_of(spark, table), "x-11")


def test_names_of_loads():
    assert P.batch_of("ab-cd-000000000012") == ("ab-cd", 12)
    assert P.batch_of("own") == ("own", 0) and P.batch_of("own-name") == ("own-name", 0)


def test_twenty_cycles_read_no_more_than_two(spark, tmp_path, topic):
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), models=change_models(topic.name, partial=True))
    read = {}
    for cycle in range(1, 21):
        put(tmp_path / "q", f"{cycle:02d}.bin", FRAMES)
        pipeline.cycle()
        found = [spark.table(name) for name in reports(topic)]
        assert not any("/silver" in file for df in found for file in df.inputFiles())
        read[cycle] = len(P.counted(P.runs_of(spark, partial_sums_table(pipeline.models[-1]))))
    assert read[2] == 2 and read[20] <= 2 * (P.FAN - 1)
    same_as_batch(spark, topic)


def test_a_new_report_gets_the_history_and_a_restart_nothing_twice(spark, tmp_path, topic):
    feed, checkpoint = Feed(topic, str(tmp_path / "q")), str(tmp_path / "c")
    for number in range(3):
        put(tmp_path / "q", f"{number}.bin", FRAMES[8 * number : 8 * number + 8])
        run_once(spark, feed, checkpoint)
    for _ in range(2):
        run_once(spark, feed, checkpoint, models=change_models(topic.name, partial=True))
        same_as_batch(spark, topic)


def test_compaction_counts_nothing_twice(spark, tmp_path, topic):
    settings = {"models": [*change_models(topic.name, partial=True), Model(f"all_{topic.name}", "gold", lambda s: s, (topic.name,), "incremental", ("id",))]}
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), **settings)
    for number in range(3):
        put(tmp_path / "q", f"{number}.bin", FRAMES[8 * number : 8 * number + 8])
        pipeline.cycle()
    pipeline.compact(TODAY + datetime.timedelta(days=1))
    put(tmp_path / "q", "9.bin", [frame(None, "log", 3, log_action="a"), frame(99, "new", 3)])
    pipeline.cycle()
    same_as_batch(spark, topic)
    assert spark.table(f"gold.all_{topic.name}").count() == 26
    # A report that comes later has the compacted days too.
    late = Model(f"late_{topic.name}", "gold", f"SELECT type, count(*) AS n FROM {{{topic.name}}} GROUP BY type", (), "partial", ("type",))
    pipeline = Pipeline(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), models=[late])
    pipeline.cycle()
    assert rows(spark.table(late.full_name)) == [("edit", 8), ("log", 9), ("new", 9)]


def test_a_partial_model_needs_one_topic(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES)
    other = Topic(topic.name + "_b")
    feeds = [Feed(topic, str(tmp_path / "q")), Feed(other, str(tmp_path / "q"))]
    model = Model("both_" + topic.name, "gold", f"SELECT 1 AS k, count(*) AS n FROM {{{topic.name}}}, {{{other.name}}}", (), "partial", ("k",))
    with pytest.raises(ModelRunError, match="must need one topic"):
        run_once(spark, feeds, str(tmp_path / "c"), models=[model])


def test_null_keys_of_a_load_that_is_fed_again_stay_single(spark, tmp_path, topic, monkeypatch):
    """The driver ends after a keyed model was refreshed and before that was noted."""
    model = Model(f"all_{topic.name}", "gold", lambda silver: silver, (topic.name,), "incremental", ("id",))
    feed, checkpoint = Feed(topic, str(tmp_path / "q")), str(tmp_path / "c")
    put(tmp_path / "q", "1.bin", [frame(None), frame(1), frame(None)])
    run_once(spark, feed, checkpoint, models=[model])
    put(tmp_path / "q", "2.bin", [frame(None), frame(2)])
    notes = []

    def cut(spark, model, state, root=None):
        notes.append(state)
        if len(notes) == 2:
            raise KeyboardInterrupt
        note(spark, model, state, root)

    monkeypatch.setattr(pipelines, "note", cut)
    with pytest.raises(KeyboardInterrupt):
        run_once(spark, feed, checkpoint, models=[model])
    monkeypatch.setattr(pipelines, "note", note)
    put(tmp_path / "q", "3.bin", [frame(3)])
    run_once(spark, feed, checkpoint, models=[model])
    assert sorted(str(r["id"]) for r in spark.table(model.full_name).collect()) == ["1", "2", "3", "None", "None", "None"]


def test_what_is_noted_stays_as_small_after_many_loads(spark, topic):
    model = Model(f"m_{topic.name}", "gold", lambda silver: silver, (topic.name,), "incremental", ("id",))
    note(spark, model, Taken(9_999, {topic.name: {"stream": 9_999}}))
    state = taken(spark, model)
    assert state == Taken(9_999, {topic.name: {"stream": 9_999}}, None)
    table = spark.createDataFrame([(f"stream-{k:012d}",) for k in range(9_990, 10_010)], "load_id STRING").withColumn("load_day", F.lit(TODAY))
    wanted = rows_between(table, state.marks[topic.name], {"stream": 10_005})
    assert wanted.count() == 6
    assert len(wanted._jdf.queryExecution().analyzed().toString()) < 5_000


def test_reports_of_other_runs_are_exported_too(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES)
    for name in ("one", "two"):
        model = Model(f"{name}_{topic.name}", "gold", f"SELECT count(*) AS n FROM {{{topic.name}}}", materialized="table")
        run_once(spark, Feed(topic, str(tmp_path / "q")), str(tmp_path / "c"), models=[model], csv_dir=str(tmp_path / name))
    assert {f.name for f in (tmp_path / "two").glob("*.csv")} == {f"one_{topic.name}.csv", f"two_{topic.name}.csv"}


def test_a_topic_without_a_file_is_empty(spark, tmp_path, topic):
    put(tmp_path / "q", "1.bin", FRAMES)
    (tmp_path / "none").mkdir()
    idle = Topic(topic.name + "_idle")
    feeds = [Feed(topic, str(tmp_path / "q")), Feed(idle, str(tmp_path / "none"))]
    text = f"SELECT (SELECT count(*) FROM {{{topic.name}}}) AS a, (SELECT count(*) FROM {{{idle.name}}}) AS b, (SELECT count(*) FROM {{{idle.name}_raw}}) AS c"
    model = Model(f"both_{topic.name}", "gold", text)
    models = [model, *change_models(idle.name, partial=True)]
    assert rows(run_once(spark, feeds, str(tmp_path / "c"), models=models).results[model.full_name]) == [(24, 0, 0)]
    assert spark.table(reports(idle)[0]).count() == 0
    put(tmp_path / "none", "1.bin", [*FRAMES[:5], "data: {cut\n\n"])
    pipeline = run_once(spark, feeds, str(tmp_path / "c"), models=models)
    assert rows(pipeline.results[model.full_name]) == [(24, 5, 5)]
    assert pipeline.loaded == {topic.name: 0, idle.name: 6} and sum(pipeline.loaded.values()) == 6
    same_as_batch(spark, idle)


def test_only_models_that_a_load_reaches_are_run(spark, tmp_path, topic):
    other = Topic(topic.name + "_b")
    feeds = [Feed(topic, str(tmp_path / "a")), Feed(other, str(tmp_path / "b"))]
    ran = []

    def counted(name):
        def build(*frames):
            ran.append(name)
            return frames[0].groupBy("type").count()

        return build

    models = [Model(f"{t.name}_n", "gold", counted(t.name), (t.name,), "table") for t in (topic, other)]
    models.append(Model(f"{topic.name}_top", "gold", lambda n: ran.append("top") or n, (f"{topic.name}_n",), "table"))
    models.append(Model(f"{other.name}_raws", "gold", f"SELECT count(*) AS n FROM {{{other.name}_raw}}", materialized="table"))
    place = lambda model: spark.sql(f"DESCRIBE TABLE EXTENDED {model.full_name}").where("col_name = 'Location'").first()["data_type"]
    put(tmp_path / "a", "1.bin", FRAMES[:6])
    put(tmp_path / "b", "1.bin", FRAMES[:6])
    pipeline = Pipeline(spark, feeds, str(tmp_path / "c"), models=models)
    pipeline.cycle()
    assert sorted(ran) == sorted([topic.name, other.name, "top"])
    before = [place(model) for model in models]
    put(tmp_path / "a", "2.bin", FRAMES[6:])
    pipeline.cycle()
    assert ran[3:] == [topic.name, "top"]
    assert [a == b for a, b in zip(before, map(place, models), strict=True)] == [False, True, False, True]
    assert pipeline.results[models[0].full_name].agg(F.sum("count")).first()[0] == 24
    pipeline.cycle()  # idle
    assert len(ran) == 5
    put(tmp_path / "b", "2.bin", FRAMES[6:8])
    pipeline.cycle()
    assert ran[5:] == [other.name]
    assert [r["n"] for r in spark.table(models[3].full_name).collect()] == [8]
