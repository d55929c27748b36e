import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import bronze as B
from millrace.operators import relational as R
from millrace.plans import gold as G
from millrace.plans import silver as V
from millrace.plans.runner import CHANGE_MODELS, Model, ModelRunError, change_models, run_models, sql_model


def change(**fields):
    meta = {"uri": "u", "domain": fields.pop("domain", "d"), "dt": fields.pop("dt", "2024-01-01T00:00:30Z")}
    return json.dumps({"id": 1, "type": "edit", "meta": meta, **fields})


@pytest.fixture
def silver(texts):
    def make(*events):
        return V.silver_recentchange(texts(events, "event"))

    return make


def test_silver_columns_and_types(silver):
    df = silver(
        change(
            id=7,
            namespace=0,
            title="t",
            comment=None,
            user="u",
            bot=True,
            minor="false",
            revision={"new": 12, "old": 10},
            length={"new": 5},
            patrolled=True,
            log_params={"b": 1, "a": "x"},
        )
    )
    row = df.withColumn("log_params", F.to_json("log_params")).first()
    assert row.asDict() == {
        "id": 7,
        "namespace": "0",
        "type": "edit",
        "title": "t",
        "comment": None,
        "user": "u",
        "bot": True,
        "minor": False,
        "revision_new": 12,
        "revision_old": 10,
        "length_new": 5,
        "length_old": None,
        "uri": "u",
        "domain": "d",
        "dt": datetime.datetime(2024, 1, 1, 0, 0, 30),
        "patrolled": True,
        "log_type": None,
        "log_action": None,
        "log_params": '{"a":"x","b":1}',
    }


def test_one_misfit_does_not_hide_the_other_columns(silver, texts):
    events = [
        change(id="x", bot="perhaps", revision=5, length=[1], title="t"),
        json.dumps({"id": 2, "type": "new", "meta": "none", "title": "t"}),
        '{"id":3,"id":4,"title":"t"}',
        change(id=1.5, title="t"),
        change(id=2.0, title="t"),
    ]
    rows = silver(*events).collect()
    assert [r.id for r in rows] == [None, 2, 4, None, 2]
    assert [r.title for r in rows] == ["t"] * 5
    assert rows[0].domain == "d" and rows[0].revision_new is None and rows[1].uri is None
    rejects = V.cast_rejects(texts(events, "event")).first()
    assert (rejects.id, rejects.bot, rejects.dt) == (2, 1, 0)
    with pytest.raises(PySparkException, match="not a bigint"):
        V.silver_recentchange(texts(events, "event"), strict=True).collect()


def test_a_value_and_parts_of_it(texts):
    event = '{"meta":{"dt":"2024-03-31T02:30:00Z","n":"4"},"id":1}'
    for order in (1, -1):
        columns = [("m", "meta", "variant"), ("dt", "meta.dt", "timestamp_ntz"), ("n", "meta.n", "bigint"), ("t", "meta", "string")][::order]
        row = V.project_events(texts([event], "event"), columns).withColumn("m", F.to_json("m")).first()
        assert row.m == row.t == '{"dt":"2024-03-31T02:30:00Z","n":"4"}'
        assert (row.n, row.dt) == (4, datetime.datetime(2024, 3, 31, 2, 30))


def test_views_by_type(silver):
    base = silver(
        change(type="new", length={"new": 9}),
        change(type="edit", revision={"new": 12, "old": 10}, length={"new": 1, "old": 4}),
        change(type="edit", revision={"new": 12}),
        change(type="categorize", comment="[[:C]] added to category"),
        change(type="external"),
        json.dumps({"id": 1}),
    )
    assert [r.length for r in V.silver_new(base).collect()] == [9]
    edits = V.silver_edit(base).collect()
    assert [(r.revision_global_offset, r.length_difference) for r in edits] == [(2, -3), (None, None)]
    assert [(r.object, r.action_type_en) for r in V.silver_categorize(base).collect()] == [("[[:C]]", "add")]
    assert V.silver_log(base).count() == 0 and base.count() == 6


def test_log_parameters(silver):
    base = silver(
        change(type="log", log_params={"duration": "infinity", "count": {"files": 2}, "flags": None}),
        change(type="log", log_params=[]),
        change(type="log", log_params=None),
        change(type="log"),
    )
    rows = V.silver_log(base).select("duration", "files", "flags", "target").collect()
    assert [tuple(r) for r in rows] == [('"infinity"', "2", "null", None)] + [(None,) * 4] * 3
    assert len(V.silver_log(base).columns) == 12 + 22


def test_gold_groups_nulls_and_orders_them_last(silver):
    base = silver(
        change(type="log", log_action="b", dt="2024-01-01T00:00:59.999Z"),
        change(type="log", log_action="a", dt="2024-01-01T00:00:00Z"),
        change(type="log", log_action="a", domain=None),
        change(type="log", domain=None),
        change(type="log", domain=None),
        change(type="log", log_action="a", dt=None),
    )
    rows = [tuple(r) for r in G.gold_logs_per_domain_and_min(base).collect()]
    first = "2024/01/01 00:00"
    assert rows == [
        ("d", "a", first, 1),
        ("d", "b", first, 1),
        (None, "a", first, 1),
        (None, None, first, 2),
        ("d", "a", None, 1),
    ]


def test_human_vs_bot_equals_the_union_of_both_views(silver):
    base = silver(
        change(type="new", bot=True),
        change(type="edit", bot=True),
        change(type="edit", bot=False),
        change(type="edit"),
        change(type="log", bot=True),
        change(type="edit", bot=False, dt="2023-12-31T23:59:00+02:00"),
    )
    union = R.union_all(*[part.select("bot", "dt") for part in (V.silver_edit(base), V.silver_new(base))])
    expected = R.sort_nulls_last(G.count_by_minute_bool(union), "minute", "bot").collect()
    rows = G.gold_human_vs_bot(base).collect()
    assert rows == expected
    assert [tuple(r) for r in rows] == [
        ("2023/12/31 21:59", False, 1),
        ("2024/01/01 00:00", False, 1),
        ("2024/01/01 00:00", True, 2),
        ("2024/01/01 00:00", None, 1),
    ]


def test_gold_reads_only_what_it_needs(spark, silver, tmp_path):
    silver(change(type="new", bot=True)).write.parquet(str(tmp_path / "silver"))
    plan = G.gold_human_vs_bot(spark.read.parquet(str(tmp_path / "silver")))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "ReadSchema: struct<type:string,bot:boolean,dt:timestamp_ntz>" in text
    assert "In(type, [edit,new])" in text or "In(type, [new,edit])" in text
    assert text.count("FileScan") == 1


def test_json_array_explode(texts):
    df = texts(['[{"id": "123", "val": 1}]', "[]", '[1,"a",null]'], "text")
    assert [r[0] for r in B.explode_json_array(df, "text").select(F.to_json("event")).collect()] == [
        '{"id":"123","val":1}',
        "1",
        '"a"',
        "null",
    ]


def test_topics_have_their_own_keys(spark):
    frames = spark.createDataFrame(
        [("t1", 'data: {"id":1}'), ("t1", 'data: {"x":1}'), ("t2", 'data: {"x":1}'), ("t2", "data: {"), ("t3", "data: 1")],
        "topic STRING, value STRING",
    )
    topics = [B.Topic("t1", ("id",)), B.Topic("t2", ())]
    loaded = B.load_all(frames, topics).select("topic", "event").collect()
    assert [tuple(r) for r in loaded] == [("t1", '{"id":1}'), ("t2", '{"x":1}')]
    totals = {r.topic: (r.seen, r.loaded) for r in B.topic_totals(frames, topics).collect()}
    assert totals == {"t1": (2, 1), "t2": (2, 1)}


def test_models_run_after_what_they_need(spark, silver):
    base = silver(change(type="log", log_action="a"), change(type="edit", bot=True))
    total = Model(
        "totals",
        "gold",
        "SELECT sum(count_actions) AS n FROM {recentchange_logs_per_domain_and_min}",
        ("recentchange_logs_per_domain_and_min",),
        materialized="table",
    )
    results = run_models(spark, [total, *CHANGE_MODELS], {"recentchange": base})
    assert list(results)[-1] == "gold.totals" or "gold.totals" in results
    assert results["gold.totals"].first().n == 1
    assert spark.table("gold.totals").first().n == 1
    assert spark.table("`silver.recentchange_edit`").count() == 1
    assert B.relation(spark, "recentchange", {"recentchange": base}) is base

    # A second run replaces the table, also when its columns change.
    again = [Model("totals", "gold", f"SELECT count(*) AS {name} FROM {{recentchange}}", ("recentchange",), "table") for name in ("n", "n", "m")]
    for model in again:
        run_models(spark, [model], {"recentchange": base})
        assert [tuple(r) for r in spark.table("gold.totals").collect()] == [(2,)]
    assert spark.table("gold.totals").columns == ["m"]


def test_sql_models_equal_the_functions_and_are_stored(spark, silver):
    base = silver(
        change(type="new", bot=True, length={"new": 9}),
        change(type="edit", revision={"new": 12, "old": 10}, length={"new": 1, "old": 4}, comment="it's"),
        change(type="categorize", comment="[[:C]] added to [[D]]"),
        change(type="categorize", comment="removed"),
        change(type="log", log_action="b", log_params={"duration": "x", "count": {"files": 2}}),
        change(type="log", dt=None),
    )
    base.write.mode("overwrite").saveAsTable("default.stored_changes")
    models = change_models("stored")
    results = run_models(spark, models, {"stored": spark.table("stored_changes")}, stored={"stored": "default.stored_changes"})
    functions = [V.silver_new, V.silver_edit, V.silver_categorize, V.silver_log, G.gold_logs_per_domain_and_min, G.gold_human_vs_bot]
    other = spark.newSession()
    for model, function in zip(models, functions, strict=True):
        expected = [tuple(r) for r in function(base).collect()]
        found = other.table(model.full_name)
        assert found.columns == results[model.full_name].columns == function(base).columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_needs_follow_from_the_text():
    assert Model("m", "gold", "SELECT * FROM {a} JOIN {b} USING (x) WHERE y IN (SELECT y FROM {a})").needs == ("a", "b")


def test_incremental_model(spark, texts):
    model = Model("by_id", "silver", lambda df: df, ("batch",), "incremental", ("id",), "id div 2")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        batch = spark.createDataFrame(rows, "id BIGINT, v STRING")
        result = run_models(spark, [model], {"batch": batch})["silver.by_id"]
    assert sorted(tuple(r) for r in result.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_model_failures(spark):
    df = spark.range(3)
    models = [
        Model("bad", "gold", "SELECT no_such_column FROM {base}", ("base",)),
        Model("after", "gold", "SELECT * FROM {bad}", ("bad",)),
        Model("good", "gold", "SELECT count(*) AS n FROM {base}", ("base",)),
    ]
    with pytest.raises(ModelRunError) as all_of_them:
        run_models(spark, models, {"base": df}, fail_fast=False)
    assert set(all_of_them.value.messages) == {"gold.bad", "gold.after"}
    assert "no_such_column" in str(all_of_them.value)
    with pytest.raises(ModelRunError) as first:
        run_models(spark, models[:2], {"base": df})
    assert set(first.value.messages) == {"gold.bad"}
    assert run_models(spark, models, {"base": df}, loaded=0) == {}


def test_user_sql(spark):
    assert sql_model(spark, "SELECT sum(id) AS s FROM {numbers}", {"numbers": spark.range(4)}).first().s == 6
