"""Keyed tables that are merged on read."""

import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge as M
from millrace.operators.relational import keyed_anti_join, upsert, write_bucketed

SCHEMA = "id BIGINT, part STRING, v STRING"


@pytest.fixture
def table():
    return f"keyed_{uuid.uuid4().hex[:8]}.t"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def size_of(spark, table):
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    return {str(f): f.stat().st_size for f in pathlib.Path(place).rglob("part-*")}


@pytest.mark.parametrize(("fan", "null_safe"), [(2, False), (3, True), (8, False)])
def test_any_batches_equal_delete_and_insert(spark, table, fan, null_safe):
    pick = random.Random(fan)
    expected = frame(spark, [])
    for number in range(9):
        batch = [(pick.choice([None, *range(12)]), pick.choice([None, "a", "b"]), f"{number}") for _ in range(pick.randint(0, 14))]
        batch += batch[:2]  # duplicates stay
        M.merge_batch(frame(spark, batch), table, ["id", "part"], buckets=3, null_safe=null_safe, fan=fan)
        expected = frame(spark, rows(upsert(expected, frame(spark, batch), ["id", "part"], null_safe)))
        assert rows(M.merged(spark, table)) == rows(expected)
    live = [p for p in M.parts_of(spark, table) if not any(M._spans(q, p) for q in M.parts_of(spark, table))]
    assert len(live) <= 3 * (fan - 1) * 5


def test_a_batch_fed_again_replaces_itself(spark, table):
    M.merge_batch(frame(spark, [(1, "a", "old"), (None, "a", "old")]), table, ["id"], buckets=2, run=0)
    batch = frame(spark, [(1, "a", "new"), (None, "a", "new"), (None, "a", "new")])
    for _ in range(3):
        M.merge_batch(batch, table, ["id"], run=1)
    expected = [(1, "a", "new"), (None, "a", "new"), (None, "a", "new"), (None, "a", "old")]
    assert rows(M.merged(spark, table)) == sorted(expected, key=str)
    # Also after it has been folded.
    for run in range(2, 6):
        M.merge_batch(frame(spark, [(run, "a", "x")]), table, ["id"], run=run, fan=2)
    M.merge_batch(batch, table, ["id"], run=1, fan=2)
    assert M.merged(spark, table).where("id IS NULL").count() == 3


def test_a_small_batch_of_random_keys_writes_little(spark, table):
    wide = F.concat_ws("-", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(k))) for k in range(6)]).alias("v")
    M.merge_batch(spark.range(60_000).select("id", wide), table, ["id"])
    before = size_of(spark, table)
    M.merge_batch(spark.range(60_000).where("xxhash64(id) % 100 = 0").select("id", F.concat(wide, F.lit("!")).alias("v")), table, ["id"])
    after = size_of(spark, table)
    assert before.items() <= after.items()
    assert sum(after.values()) - sum(before.values()) < 0.02 * sum(before.values())
    assert M.merged(spark, table).count() == 60_000


def test_folding_rewrites_only_buckets_with_many_runs(spark, table):
    M.merge_batch(spark.range(40).select("id", F.lit("a").alias("v")), table, ["id"], bucket="id div 10", fan=3)
    for n in range(2):
        M.merge_batch(spark.range(3).select("id", F.lit(f"b{n}").alias("v")), table, ["id"], fan=3)
    levels = {(bucket, level) for bucket, level, _, _ in M.parts_of(spark, table)}
    assert ("0", 1) in levels and not {("1", 1), ("2", 1), ("3", 1)} & levels
    assert rows(M.merged(spark, table).where("id < 4")) == [(0, "b1"), (1, "b1"), (2, "b1"), (3, "a")]
    # What was folded is dropped with the next folding.
    assert M.fold_runs(spark, table, fan=3) == []
    assert sum(bucket == "0" for bucket, *_ in M.parts_of(spark, table)) == 1


def test_columns_go_by_name_and_must_be_the_same(spark, table):
    M.merge_batch(frame(spark, [(1, "a", "x")]), table, ["id"])
    M.merge_batch(frame(spark, [(1, "b", "y")]).select("v", "part", "id"), table, ["id"])
    assert rows(M.merged(spark, table)) == [(1, "b", "y")]
    with pytest.raises(ValueError, match="has the columns"):
        M.merge_batch(frame(spark, []).drop("v"), table, ["id"])


def test_an_empty_first_batch(spark, table):
    M.merge_batch(frame(spark, []), table, ["id"])
    assert M.merged(spark, table).collect() == [] and M.last_run(spark, table) is None


def scanned(df):
    """Rows that the file scans of a query gave out."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            plan.append(node.plan())
        elif name.startswith("Scan parquet") and "v:" in str(node.schema().simpleString()).replace("v:string", "v:"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
    return total


def test_a_few_keys_are_found_by_reading_few_row_groups(spark, table):
    key = F.md5(F.col("id").cast("string")).alias("k")  # every run has keys of the whole range
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        for run in range(5):
            part = spark.range(run * 50_000, (run + 1) * 50_000)
            M.merge_batch(part.select(key, F.concat(key, F.lit("-v")).alias("v")), table, ["k"], buckets=2)
    finally:
        spark.conf.unset("parquet.block.size")
    wanted = spark.range(100_000, 150_000, 500).select(key)
    found = M.lookup(spark, table, wanted)
    assert rows(found) == rows(wanted.select("k", F.concat("k", F.lit("-v")))) and found.count() == 100
    # The keys are in one run, where they lie in most row groups; the others have them in their ranges too.
    assert scanned(found) < 60_000
    M.merge_batch(wanted.limit(3).select("k", F.lit("new").alias("v")), table, ["k"])
    assert M.lookup(spark, table, wanted).where("v = 'new'").count() == 3
    assert M.lookup(spark, table, wanted, most=5).count() == 100  # by a join
    assert M.lookup(spark, table, wanted.where("false")).count() == 0


def test_a_bucketed_target_is_not_moved(spark):
    name = f"silver.b{uuid.uuid4().hex[:8]}"
    target = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("id"), F.col("id").alias("n"))
    write_bucketed(target, name, ["id"], 6)
    batch = spark.range(0, 5000, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = keyed_anti_join(spark.table(name), batch, ["id"], buckets=6)
        assert rows(found) == rows(keyed_anti_join(target, batch, ["id"]))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    target_side = plan[plan.index("Scan parquet") - 400 : plan.index("Scan parquet")] if "Scan parquet" in plan else plan
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2 and "SelectedBucketsCount: 6 out of 6" in plan
    assert "Exchange hashpartitioning(id" not in target_side
