"""Registered queries against their SQL, and the pipeline, over the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences, oracle_connection
from millrace.llm.queries import ORACLE, QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(rows, oracle_connection(SF_DIR).execute(ORACLE[name]).df()) == ""


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages_keep_the_columns_and_hand_on_all_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == names
        counts.append(docs.count())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(rows) == counts[-1]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


@pytest.fixture
def tables(tmp_path, spark):
    """A folder of tables whose documents are given; the rest are the smallest ones."""

    def make(docs):
        folder = tmp_path / "tables"
        docs.write.mode("overwrite").parquet(str(folder / "documents.parquet"))
        for name in ("benchmark", "labels"):
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return make


def awkward(spark):
    """All awkward cases, with columns that bear the names of the stages' own."""
    docs = cases.documents(spark)
    for name in ("copy_no", "n_copies", "shuffle_key", "content", "mix_source", "dropped_id", "hit_id", "key_id"):
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    return docs


@pytest.mark.parametrize("number", range(4))
def test_each_stage_takes_awkward_rows_and_keeps_their_columns(spark, tables, number):
    docs, sf_dir = awkward(spark), tables(cases.documents(spark))
    stage = corpus_pipeline.STAGES[number][1]
    kept = stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    found = kept.collect()
    before, after = ({(r.doc_id, r.text) for r in rows} for rows in (docs.collect(), found))
    assert after <= before
    assert all(r[name] == f"my {name}" for r in found for name in docs.columns[-8:])
    assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_the_last_stage_takes_awkward_rows(spark, tables):
    docs, sf_dir = awkward(spark), tables(cases.documents(spark))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids != sorted(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


def test_a_table_loaded_twice_leaves_as_if_loaded_once(spark, tables):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")))
    once, twice = (corpus_pipeline.near_dedup(spark, x, SF_DIR).collect() for x in (docs, docs.unionByName(docs)))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text)
    assert sorted(map(tuple, once), key=str) == sorted(map(tuple, twice), key=str) and len({key(r) for r in once}) == len(once)
