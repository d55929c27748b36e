import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators.relational import sort_nulls_last
from millrace.sinks.csv_export import export_csv, export_layer

VALUES = [
    ("a;b", 1, True, "2024-01-01 10:00:00"),
    ('say "hi"', None, False, "2024-01-01 10:00:00.25"),
    ("line\nbreak", 3, None, None),
    ("  blanks  ", 4, True, "2024-01-01 00:00:00"),
    ("", 5, True, None),
    (None, 6, True, None),
    ("plain", 7, False, None),
    ("back\\slash", 8, False, None),
    ("'single'", 9, False, None),
]


@pytest.fixture
def relation(spark):
    df = spark.createDataFrame(VALUES, "s STRING, n BIGINT, b BOOLEAN, t STRING")
    return df.withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_file_equals_the_one_duckdb_writes(relation, tmp_path):
    ordered = sort_nulls_last(relation, "n")
    paths = export_csv({"gold.values": ordered}, str(tmp_path / "csv"))
    assert paths == {"gold.values": f"{tmp_path}/csv/values.csv"}
    values = ", ".join("(" + ", ".join("?" for _ in row) + ")" for row in VALUES)
    duckdb.execute(
        f"COPY (SELECT * REPLACE (CAST(t AS TIMESTAMP) AS t) FROM (VALUES {values}) v(s, n, b, t) "
        f"ORDER BY n NULLS LAST) TO '{tmp_path}/expected.csv' (FORMAT CSV, HEADER, DELIM ';')",
        [cell for row in VALUES for cell in row],
    )
    assert (tmp_path / "csv" / "values.csv").read_text() == (tmp_path / "expected.csv").read_text()


def test_export_replaces_and_leaves_nothing_else(spark, tmp_path):
    for n in (3, 2):
        export_csv({"one": spark.range(n).coalesce(1), "two": spark.range(0)}, str(tmp_path / "csv"))
    found = sorted(p.name for p in (tmp_path / "csv").iterdir() if not p.name.endswith(".crc"))
    assert found == ["one.csv", "two.csv"]
    assert (tmp_path / "csv" / "one.csv").read_text() == "id\n0\n1\n"
    assert (tmp_path / "csv" / "two.csv").read_text() == "id\n"


def test_one_file_holds_all_partitions_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(1000).select((999 - F.col("id")).alias("n")).orderBy("n")
    export_csv({"big": df}, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [int(line) for line in (tmp_path / "big.csv").read_text().splitlines()[1:]] == list(range(1000))


def test_a_failed_export_leaves_the_report(spark, tmp_path):
    export_csv({"one": spark.range(2)}, str(tmp_path))
    broken = spark.range(3).select(F.raise_error(F.lit("broken report")).cast("int").alias("id"))
    with pytest.raises(Exception, match="broken report"):
        export_csv({"one": broken}, str(tmp_path))
    assert (tmp_path / "one.csv").read_text() == "id\n0\n1\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["one.csv"]


def test_equal_names_in_two_layers(spark, tmp_path):
    paths = export_csv({"gold.n": spark.range(1), "silver.n": spark.range(2)}, str(tmp_path))
    assert paths == {"gold.n": f"{tmp_path}/gold.n.csv", "silver.n": f"{tmp_path}/silver.n.csv"}


def test_folders_on_request_in_order(spark, tmp_path):
    df = spark.range(1000).select((999 - F.col("id")).alias("n")).orderBy("n")
    path = export_csv({"big": df}, str(tmp_path), single_file=False)["big"]
    parts = sorted((tmp_path / "big.csv").glob("part-*"))
    assert path.endswith("big.csv")
    numbers = [int(line) for part in parts for line in part.read_text().splitlines()[1:]]
    assert numbers == list(range(1000))


def test_variant_columns_are_json_text(spark, tmp_path):
    export_csv({"v": spark.sql("""SELECT parse_json('{"a":"x"}') AS v""")}, str(tmp_path))
    assert (tmp_path / "v.csv").read_text() == 'v\n"{""a"":""x""}"\n'


def test_layer_export(spark, tmp_path):
    assert export_layer(spark, str(tmp_path), "no_such_layer") == {}
    spark.sql("CREATE DATABASE reports")
    spark.sql("CREATE VIEW reports.numbers AS SELECT id AS n FROM range(2)")
    assert list(export_layer(spark, str(tmp_path), "reports")) == ["reports.numbers"]
    assert (tmp_path / "numbers.csv").read_text() == "n\n0\n1\n"
