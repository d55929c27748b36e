import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import bronze as B
from millrace.operators import incremental as I
from millrace.operators import relational as R
from millrace.operators.layout import compact_days


@pytest.fixture
def table():
    return f"silver.t_{uuid.uuid4().hex}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def keyed(spark, values):
    return spark.createDataFrame(values, "id BIGINT, v STRING")


def test_upsert_keeps_batch_duplicates_and_null_keys(spark):
    target = keyed(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")])
    batch = keyed(spark, [(1, "x"), (1, "x"), (3, "y"), (None, "m")])
    assert rows(R.upsert(target, batch, ["id"])) == rows(
        keyed(spark, [(1, "x"), (1, "x"), (2, "c"), (3, "y"), (None, "m"), (None, "n")])
    )
    assert rows(R.upsert(target, batch, ["id"], null_safe=True)) == rows(
        keyed(spark, [(1, "x"), (1, "x"), (2, "c"), (3, "y"), (None, "m")])
    )


def test_anti_join_on_several_keys(spark):
    target = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, None, 0)], "k BIGINT, l STRING, v INT")
    batch = spark.createDataFrame([(1, "a"), (2, None)], "k BIGINT, l STRING")
    assert rows(R.keyed_anti_join(target, batch, ["k", "l"])) == [(1, "b", 0), (2, None, 0)]
    assert rows(R.keyed_anti_join(target, batch, ["k", "l"], null_safe=True)) == [(1, "b", 0)]


def test_a_hot_key_does_not_multiply_rows(spark):
    """A key that fills a third of both sides: the join emits no pairs."""
    target = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), F.lit("t").alias("v"))
    batch = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 10**6).alias("id"), F.lit("b").alias("v"))
    counts = {r.v: r["count"] for r in R.upsert(target, batch, ["id"]).groupBy("v").count().collect()}
    assert counts == {"t": 20000, "b": 3000}


@pytest.mark.parametrize("bucket", [None, "id div 10"])
def test_stored_upsert_equals_the_plain_one(spark, table, bucket):
    batches = [
        [(i, "first") for i in range(50)] + [(None, "n1")],
        [(i, "second") for i in range(45, 60)] + [(45, "again"), (None, "n2")],
        [(3, "third")],
    ]
    expected = keyed(spark, [])
    for values in batches:
        batch = keyed(spark, values)
        I.upsert_table(batch, table, ["id"], bucket=bucket, buckets=4)
        expected = R.upsert(expected, batch, ["id"])
    assert rows(spark.table(table).drop(I.BUCKET)) == rows(expected)


def test_stored_upsert_leaves_other_buckets_alone(spark, table):
    I.upsert_table(keyed(spark, [(i, "a") for i in range(100)]), table, ["id"], bucket="id div 10")
    before = set(spark.table(table).where("id >= 10").inputFiles())
    untouched = {f for f in before if f"{I.BUCKET}=0/" not in f}
    I.upsert_table(keyed(spark, [(5, "b")]), table, ["id"])
    after = set(spark.table(table).inputFiles())
    assert untouched <= after and len(untouched) >= 9
    assert spark.table(table).where("v = 'b'").count() == 1 and spark.table(table).count() == 100


def test_a_small_batch_of_random_keys_leaves_most_files_alone(spark, table):
    """The default layout: the number of buckets follows the size of the first batch."""
    rows = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    before_bytes, I.BUCKET_BYTES = I.BUCKET_BYTES, 4000
    try:
        I.upsert_table(rows, table, ["id"])
    finally:
        I.BUCKET_BYTES = before_bytes
    before = set(spark.table(table).inputFiles())
    I.upsert_table(spark.range(0, 20000, 1000).select("id", F.lit("new").alias("v")), table, ["id"])
    after = set(spark.table(table).inputFiles())
    assert len(before) > 200 and len(before & after) > 0.85 * len(before)
    assert spark.table(table).count() == 20000 and spark.table(table).where("v = 'new'").count() == 20


def test_the_staged_batch_goes_when_a_write_fails(spark, table):
    from millrace.session import shared_dir
    from pathlib import Path

    I.upsert_table(keyed(spark, [(1, "a")]), table, ["id"])
    with pytest.raises(Exception):
        I.upsert_table(spark.range(2).select("id", F.lit(1).alias("other")), table, ["id"])
    left = list(Path(shared_dir(spark)).glob("millrace/upsert-*"))
    assert left == []


def test_a_variant_column_is_stored(spark, table):
    batch = spark.sql("""SELECT 1 AS id, parse_json('{"a":[1]}') AS v""")
    I.upsert_table(batch, table, ["id"])
    I.upsert_table(batch, table, ["id"])
    assert [r[0] for r in spark.table(table).select(F.to_json("v")).collect()] == ['{"a":[1]}']


def test_loads_replace_themselves(spark, table):
    I.append_load(keyed(spark, [(1, "a")]), table, "l1")
    I.append_load(keyed(spark, [(2, "b"), (2, "b")]), table, "l2")
    I.append_load(keyed(spark, [(2, "b"), (2, "b")]), table, "l2")
    assert rows(spark.table(table).drop("load_day")) == [(1, "a", "l1"), (2, "b", "l2"), (2, "b", "l2")]


def test_columns_go_by_name(spark, table):
    I.append_load(spark.sql("SELECT 1 AS a, 2 AS b"), table, "l1")
    I.append_load(spark.sql("SELECT 4 AS b, 3 AS a"), table, "l2")
    assert rows(spark.table(table).select("a", "b")) == [(1, 2), (3, 4)]
    for batch in ("SELECT 1 AS a", "SELECT 1 AS a, 2 AS b, 3 AS c", "SELECT 1 AS a, 2 AS c"):
        with pytest.raises(ValueError, match="has the columns"):
            I.append_load(spark.sql(batch), table, "l3")


def test_closed_days_become_one_partition(spark, table):
    for n in range(4):
        I.append_load(keyed(spark, [(n, "x"), (n, "y")]), table, f"l'{n}")
    tomorrow = datetime.datetime.now(datetime.timezone.utc).date() + datetime.timedelta(days=1)
    assert compact_days(spark, table, tomorrow - datetime.timedelta(days=1)) == []
    assert len(compact_days(spark, table, tomorrow)) == 1
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 1
    expected = sorted((n, v) for n in range(4) for v in "xy")
    assert rows(spark.table(table).select("id", "v")) == expected
    # A late load of that day is merged in, and a repeated run changes nothing.
    I.append_load(keyed(spark, [(9, "z")]), table, "late")
    for _ in range(2):
        compact_days(spark, table, tomorrow)
    assert rows(spark.table(table).select("id", "v")) == [*expected, (9, "z")]


def test_the_last_file_name_is_kept_with_the_table(spark):
    topic = f"t_{uuid.uuid4().hex}"
    assert B.last_file_name(spark, topic) is None
    for names in (["3.bin", "5.bin"], ["4.bin"], []):
        B.append_bronze(spark.createDataFrame([("{}", n) for n in names], "event STRING, file_name STRING"), topic)
    assert B.last_file_name(spark, topic) == "5.bin"


def test_bronze_loads(spark, texts):
    topic = f"t_{uuid.uuid4().hex}"
    first = B.append_bronze(texts(['{"id": 1}'], "event"), topic)
    second = B.append_bronze(texts(['{"id": 1}', '{"id":2}'], "event"), topic)
    B.append_bronze(texts(['{"id": 1}', '{"id":2}'], "event"), topic, load_id=second)
    B.append_bronze(texts([], "event"), topic)
    assert first != second
    # The text is kept as it came.
    assert rows(spark.table(f"bronze.{topic}_raw").select("event")) == [('{"id": 1}',), ('{"id": 1}',), ('{"id":2}',)]


def test_a_bronze_table_can_be_streamed(spark, texts, tmp_path):
    topic, seen = f"t_{uuid.uuid4().hex}", []
    table = f"bronze.{topic}_raw"
    for event in ('{"id":1}', '{"id":2}'):
        B.append_bronze(texts([event], "event"), topic)
        stream = B.relation(spark, table, streaming=True)
        writer = stream.writeStream.foreachBatch(lambda batch, _: seen.append([r.event for r in batch.collect()]))
        writer = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        writer.start().awaitTermination()
    assert seen == [['{"id":1}'], ['{"id":2}']]
