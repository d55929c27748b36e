"""Fingerprints against a plain Python version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints
from tests.llm import cases

THRESHOLD = fingerprints.threshold()


def plain_sketch(text, size=5, floor=16, threshold=THRESHOLD):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    runs = [words] if 0 < len(words) < size else [words[k : k + size] for k in range(len(words) - size + 1)]
    hashes = sorted({hashlib.md5(" ".join(run).encode()).hexdigest()[:12] for run in runs})
    below = [x for x in hashes if x < threshold]
    return below if len(below) >= floor else hashes[:floor]


def plain_containment(a, b, floor=16):
    if a == b:
        return 1.0
    limit = min("g" if len(x) < floor else max(x[-1], f"{int(THRESHOLD, 16) - 1:012x}") for x in (a, b))
    a, b = ({x for x in y if x <= limit} for y in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def plain(rows, content):
    """Rows (doc_id, text) in the operator's order, each with the one after it."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is None, x[0] or 0, content[x[1]]))
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (plain_sketch(x) for x in (text, edited, following))
        near = plain_containment(own, other), plain_containment(own, after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), *near))
    return sorted(out, key=str)


def check(spark, docs, **settings):
    hashes = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = fingerprints.compare_neighbours(docs, **settings).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows, {r["t"]: r["h"] for r in hashes})


@pytest.mark.parametrize("settings", [{}, {"range_bytes": 2000}])
def test_every_awkward_case(spark, settings):
    check(spark, cases.documents(spark), **settings)


def test_many_equal_rows_are_worked_on_once(spark):
    rows = [cases.row(None, "")] * 40 + [cases.row(7, cases.prose(1))] * 25 + [cases.row(k, cases.prose(k)) for k in range(12)]
    check(spark, cases.documents(spark, rows), many=4)


def test_one_id_of_many_texts(spark):
    rows = [cases.row(5, cases.prose(k, 12)) for k in range(200)] + [cases.row(k, cases.prose(1000 + k, 9)) for k in range(20)]
    check(spark, cases.documents(spark, rows))


def test_a_single_row_is_followed_by_itself(spark):
    check(spark, cases.documents(spark, [cases.row(None, "one two three four five six seven")]))


def test_no_documents_no_rows(spark):
    assert fingerprints.compare_neighbours(cases.empty(spark)).collect() == []


def test_sketches_can_be_merged_and_read_back(spark):
    texts = [(cases.prose(1, 400), cases.prose(2, 30)), (cases.prose(3, 5), ""), (cases.prose(4, 9), cases.prose(5, 12))]
    made = spark.createDataFrame(texts, "a STRING, b STRING").select(
        F.expr(fingerprints.sketch_sql("a")).alias("a"), F.expr(fingerprints.sketch_sql("b")).alias("b")
    )
    merged = made.select(F.expr(fingerprints.merged_sql("a", "b")).alias("m"), F.expr(fingerprints.sketch_of_sql("array_join(a, '')")).alias("a")).collect()
    for (a, b), row in zip(texts, merged, strict=True):
        both = sorted({*plain_sketch(a, floor=10**9), *plain_sketch(b, floor=10**9)})
        below = [x for x in both if x < THRESHOLD]
        assert row["m"] == (below if len(below) >= 16 else both[:16])
        assert row["a"] == plain_sketch(a)


def test_a_short_text_is_found_in_a_long_one(spark):
    words = cases.prose(8, 6000).split()
    rows = [cases.row(1, " ".join(words[2000:2400])), cases.row(2, " ".join(words)), cases.row(3, cases.prose(9, 500))]
    found = {r["doc_id"]: r for r in fingerprints.compare_neighbours(cases.documents(spark, rows)).collect()}
    assert found[1]["near_next"] == 1.0 and found[2]["near_next"] == 0.0


def test_no_python_in_the_plan(spark):
    plan = fingerprints.compare_neighbours(cases.documents(spark).where("doc_id < 50"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan.replace("Scan ExistingRDD", ""))
