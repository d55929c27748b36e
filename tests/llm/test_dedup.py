import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import drop_copies, drop_repeated_rows, exact_groups
from millrace.llm.line_dedup import apply_bitmaps, keep_bitmaps
from millrace.llm.near_dedup import band_keys, components, drop_near_duplicates, merged, near_duplicates, sketch
from tests.llm import cases


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_agree_with_brute_force(spark, keep):
    data = cases.rows()
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[text or ""].append(doc_id)
    expected = Counter()
    for doc_id, text, *_ in data:
        ids = [x for x in groups[text or ""] if x is not None]
        best = (min if keep == "smallest" else max)(ids, default=None)
        expected[doc_id, best, len(groups[text or ""]), doc_id == best, sha(text)] += 1
    got = Counter(map(tuple, exact_groups(cases.documents(spark), keep).collect()))
    assert got == expected


def test_copies_are_dropped_and_columns_stay(spark):
    docs = cases.documents(spark)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in cases.rows()})  # one row each, also of rows that repeat an id
    ids = {r.text: r.doc_id for r in kept.collect()}
    assert ids["no id"] is None and ids[cases.prose(3)] == 3
    assert exact_groups(cases.empty(spark)).count() == 0


def test_runs_are_cut_between_tasks_and_added_up(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [cases.row(k, f"text {k % 3}") for k in range(200)] + [cases.row(None, "text 1")] * 5
        got = Counter(map(tuple, exact_groups(cases.documents(spark, data)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter(r[1] for r in data)
    assert got == Counter((r[0], int(r[1][-1]), sizes[r[1]], r[0] == int(r[1][-1]), sha(r[1])) for r in data)


def test_repeated_rows_leave_one(spark):
    docs = cases.documents(spark, cases.rows() * 2)
    kept = drop_repeated_rows(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter({(r[0], r[1] or "") for r in cases.rows()})
    single = docs.where("doc_id BETWEEN 10 AND 20").distinct()
    assert sorted(map(tuple, drop_repeated_rows(single).collect())) == sorted(map(tuple, single.collect()))
    assert drop_repeated_rows(cases.empty(spark)).collect() == []


def lines_by_hand(data, min_docs, keep_first):
    keyed, found = {}, defaultdict(set)
    for doc_id, text, *_ in data:
        for pos, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").translate(cases.LOWER)
            keyed[doc_id, text or "", pos] = key
            found[key].add((doc_id, text or ""))
    order = lambda x: (x[0] is not None, x[0] or 0, x[2])
    first = {}
    for place in sorted(keyed, key=order):
        first.setdefault(keyed[place], place)
    out = Counter()
    for doc_id, text, *_ in data:
        kept, dropped = [], 0
        for pos, line in enumerate((text or "").split("\n")):
            place = (doc_id, text or "", pos)
            key = keyed[place]
            if key and len(found[key]) >= min_docs and not (keep_first and first[key] == place):
                dropped += 1
            else:
                kept.append(line)
        out[doc_id, (text or "").count("\n") + 1, dropped, sha("\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("min_docs", "keep_first"), [(10, False), (2, True)])
def test_lines_agree_with_brute_force(spark, min_docs, keep_first):
    docs = cases.documents(spark)
    bitmaps = keep_bitmaps(docs, min_docs=min_docs, keep_first=keep_first)
    got = Counter(map(tuple, apply_bitmaps(docs, bitmaps, digest=True).collect()))
    assert got == lines_by_hand(cases.rows(), min_docs, keep_first)


def test_bitmaps_are_small_and_texts_come_back(spark):
    docs = cases.documents(spark)
    bitmaps = keep_bitmaps(docs, min_docs=10, keep_first=False)
    bits = next(r for r in bitmaps.collect() if r.doc_id == 200)
    unpacked = np.unpackbits(np.frombuffer(zlib.decompress(bits.keep_bitmap), np.uint8), count=bits.n_lines)
    assert unpacked.tolist() == [0, 1, 0]
    text = next(r.text for r in apply_bitmaps(docs, bitmaps).collect() if r.doc_id == 200)
    assert text == cases.prose(500, 20)
    assert keep_bitmaps(cases.empty(spark)).count() == 0


def test_a_common_line_is_counted_across_ranges(spark):
    data = [cases.row(k, f"common\nown {k}\ncommon") for k in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = keep_bitmaps(cases.documents(spark, data), min_docs=700, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, 1)] + [(k, 2) for k in range(1, 700)]


def shingle_set(text, size):
    words = cases.words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def components_by_hand(data, size, percent=80):
    sets = [(doc_id, shingle_set(text, size)) for doc_id, text, *_ in data]
    parent = {doc_id: doc_id for doc_id, _ in sets if doc_id is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, left) in enumerate(sets):
        for b, right in sets[:k]:
            if a is None or b is None or not left or not right:
                continue
            both = len(left & right)
            if 100 * both >= percent * (len(left) + len(right) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(doc_id, len(own), None if doc_id is None else root(doc_id)) for doc_id, own in sets]


def near(spark, data, size):
    rows = near_duplicates(cases.documents(spark, data), size).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_agree_with_brute_force(spark, size):
    data = cases.rows()
    assert near(spark, data, size) == sorted((str(a), n, c) for a, n, c in components_by_hand(data, size))


def test_chains_of_similar_documents_are_one_component(spark):
    """Ends of a chain aren't similar; bridges lie between members of different similarity."""
    pick, words = random.Random(4), cases.prose(1, 100).split()
    data = []
    for k in range(60):
        words = list(words)
        for _ in range(pick.randint(1, 8)):
            words[pick.randrange(100)] = f"w{pick.random()}"
        data.append(cases.row(pick.randrange(10**9), " ".join(words)))
    expected = components_by_hand(data, 2)
    assert 1 < len({c for _, _, c in expected}) < 50
    assert near(spark, data, 2) == sorted((str(a), n, c) for a, n, c in expected)


def test_near_duplicates_are_dropped_and_columns_stay(spark):
    docs = cases.documents(spark)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {100, 400, 401, 402}.issubset(ids) and not {101, 107, 301}.intersection(ids)
    assert ids.count(None) == 3
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_components_of_paths_stars_and_pairs(spark):
    path = [(k, k + 1) for k in range(100, 180)]
    star = [(7, k) for k in range(1000, 1300)]
    edges = spark.createDataFrame([*path, *star, (3, 2), (5, 5)], "u BIGINT, v BIGINT")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {k: 100 for k in range(100, 181)} | {k: 7 for k in [7, *range(1000, 1300)]} | {2: 2, 3: 2}
    more = spark.createDataFrame([(1200, 150), (3, 1), (8000, 9000)], "u BIGINT, v BIGINT")
    got = dict(map(tuple, merged(components(edges), more).collect()))
    assert got == {k: 7 for k in [7, *range(100, 181), *range(1000, 1300)]} | {1: 1, 2: 1, 3: 1, 8000: 8000, 9000: 8000}


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    values = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 7, 160, 3000):
        assert len(np.unique(sketch(values[:n], 160))) == 160
    a, b = sketch(np.unique(values[:2000]), 1600), sketch(np.unique(values[500:2500]), 1600)
    assert abs((a == b).mean() - 1500 / 2500) < 0.05
    assert len(set(band_keys(a, 320).tolist())) == 320


def test_null_columns_do_no_harm(spark):
    docs = cases.documents(spark).withColumn("source", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    assert near_duplicates(docs).where("n_shingles > 0").count() == 0
    assert {r.n_lines for r in keep_bitmaps(docs).collect()} == {1}
