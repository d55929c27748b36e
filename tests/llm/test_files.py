"""Token files, sharding and mixing."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from millrace.llm.common import literal_rows
from millrace.llm.mixing import mix, repetition_rates
from millrace.llm.queries import MIX_SEED, MIX_SIZE, QUERIES
from millrace.llm.sharding import kd_shards, write_shards
from millrace.llm.token_files import decode, decoded, encode, read_digests, write_token_files
from tests.llm import cases

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=200), max_size=5))
def test_words_decode_to_the_same_ids(documents):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in documents])]).astype(np.int64)
    ids = np.array([x for document in documents for x in document], np.uint64)
    words, block_word, first_block, doc_word = encode(ids, offsets, block_ids=32)
    assert decode(words).tolist() == ids.tolist()
    for k, document in enumerate(documents):
        own = words[doc_word[k] : doc_word[k + 1]]
        assert decode(own).tolist() == document
        starts = [*(block_word[first_block[k] : first_block[k + 1]] - doc_word[k]), len(own)]
        for block, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            assert decode(own[a:b]).tolist() == document[32 * block : 32 * block + 32]


def test_small_ids_share_words():
    words, *_ = encode(np.ones(600, np.uint64), np.array([0, 600]))
    assert len(words) == 10
    words, *_ = encode(np.full(300, 40000, np.uint64), np.array([0, 300]))
    assert len(words) == 100


def test_files_hold_what_the_tokenizer_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    path = str(tmp_path / "tokens")
    write_token_files(cases.documents(spark), path, TOKENIZER, 2)
    expected = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in cases.rows()]
    got = [(r.doc_id, list(r.ids)) for r in decoded(spark, path).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expected, key=key)
    digests = read_digests(spark, path).orderBy("start").collect()
    assert [r.start for r in digests] == np.cumsum([0] + [r.n_tokens for r in digests[:-1]]).tolist()
    ids = [r.doc_id for r in digests]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    sums = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests)
    assert sums == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in expected)


def test_rows_of_one_id_start_where_they_lie(spark, tmp_path):
    data = [cases.row(7, cases.prose(k, 3 + k)) for k in range(8)] + [cases.row(1, "one"), cases.row(9, "nine")] + [cases.row(7, cases.prose(2, 5))] * 3
    path = str(tmp_path / "tokens")
    write_token_files(cases.documents(spark, data), path, TOKENIZER, 2)
    digests = read_digests(spark, path).orderBy("start").collect()
    lies = spark.read.parquet(path).orderBy("part", "row").select("doc_id", "n_tokens").collect()
    assert [(r.doc_id, r.n_tokens) for r in digests] == [tuple(r) for r in lies]
    assert [r.start for r in digests] == np.cumsum([0] + [r.n_tokens for r in lies[:-1]]).tolist()


def test_files_follow_a_given_order(spark, tmp_path):
    docs = cases.documents(spark, [cases.row(k, cases.prose(k, 5)) for k in range(30)])
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, TOKENIZER, 2, order=[-docs["doc_id"]])
    assert [r.doc_id for r in read_digests(spark, path).orderBy("start").collect()] == list(range(29, -1, -1))


def test_mixing_keeps_columns_that_bear_its_names(spark):
    docs = cases.documents(spark).withColumn("copy_no", F.lit(-9)).withColumn("shuffle_key", F.lit("mine"))
    plain = mix(docs, size=2.0, seed=3, own_columns=False)
    assert plain.columns == docs.columns
    rows = plain.collect()
    assert rows and {(r.copy_no, r.shuffle_key) for r in rows} == {(-9, "mine")}
    assert len(rows) == mix(docs, size=2.0, seed=3).count()


def test_no_documents_no_rows(spark, tmp_path):
    write_token_files(cases.empty(spark), str(tmp_path / "none"), TOKENIZER, 2)
    assert read_digests(spark, str(tmp_path / "none")).count() == 0
    assert kd_shards(cases.empty(spark), shards=4).count() == 0
    assert mix(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_hold_all_rows_in_near_equal_bytes(spark, shards):
    data = cases.rows() + [cases.row(1000 + k, cases.prose(k, 40), f"t{k % 7}" if k % 3 else "hot") for k in range(900)]
    data = [r for r in data if len(r[1] or "") < 10000]
    got = kd_shards(cases.documents(spark, data), shards=shards).collect()
    facts = lambda text: (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], *facts(r[1])) for r in data)
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
    assert set(sizes) == set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / shards
    assert all(len(x) == 1 for x in where.values())  # equal texts together


def test_a_group_too_large_for_a_shard_is_split(spark):
    data = [cases.row(k, "the same for all of them", "s") for k in range(2000)] + [cases.row(5000 + k, cases.prose(k, 3), "t") for k in range(500)]
    sizes = Counter()
    for r in kd_shards(cases.documents(spark, data), shards=5).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 5 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_target_bytes_and_written_shards(spark, tmp_path):
    data = [cases.row(k, cases.prose(k, 50)) for k in range(300)]
    docs = cases.documents(spark, data)
    total = sum(len(r[1].encode()) + 16 for r in data)
    assigned = kd_shards(docs, target_bytes=total // 6 + 1).cache()
    assert assigned.select("shard").distinct().count() == 6
    write_shards(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 300 and set(docs.columns) < set(back.columns)


def copies_by_hand(data, size, seed):
    import hashlib

    sizes = Counter()
    for r in data:
        sizes[r[3]] += len((r[1] or "").encode())
    n, total, out = sum(b > 0 for b in sizes.values()), sum(sizes.values()), Counter()
    for r in data:
        rate = total * size / n / sizes[r[3]] if sizes[r[3]] else 0
        draws = max(1, math.ceil(rate / 32))
        for draw in range(1, draws + 1):
            ident = "null" if r[0] is None else r[0]
            u = int(hashlib.md5(f"{seed}|{ident}|{draw}".encode()).hexdigest()[:13], 16) / 16**13
            mean = rate / draws
            p = c = math.exp(-mean)
            k = 0
            while c <= u and k < 1000:
                out[r[0]] += 1
                k += 1
                p *= mean / k
                c += p
    return out


@pytest.mark.parametrize("size", [1.0, 60.0])
def test_copies_follow_the_inverted_distribution(spark, size):
    data = [r for r in cases.rows() if len(r[1] or "") < 5000]
    got = mix(cases.documents(spark, data), size=size, seed=3)
    rows = got.collect()
    assert got.columns == [*(n for n in cases.documents(spark).columns), "copy_no", "n_copies", "shuffle_key"]
    assert Counter(r.doc_id for r in rows) == copies_by_hand(data, size, 3)
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)


def test_texts_that_share_an_id_or_have_none_are_drawn_apart(spark, tmp_path):
    hot = [cases.row(None if k % 2 else 7, cases.prose(k, 30), "hot") for k in range(800)]
    rest = [cases.row(1000 + k, cases.prose(2000 + k, 30), f"s{k % 3}") for k in range(90)]
    cases.documents(spark, hot + rest).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op4_mixing"](spark, str(tmp_path)).collect()
    copies = {(r.doc_id, r.text): r.n_copies for r in rows}
    for doc_id in (None, 7):
        counts = [copies.get((doc_id, r[1]), 0) for r in hot if r[0] == doc_id]
        assert abs(sum(counts) / 400 - rate_by_hand(hot + rest, "hot")) < 0.1 and len(set(counts)) > 2
    plain = mix(cases.documents(spark, hot + rest), size=MIX_SIZE, seed=MIX_SEED).where("doc_id >= 1000").collect()
    assert Counter(r for r in rows if r.doc_id and r.doc_id >= 1000) == Counter(plain)


def rate_by_hand(data, source):
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len((r[1] or "").encode())
    return sum(sizes.values()) / len(sizes) / sizes[source]


def test_rates_meet_the_weights(spark):
    data = [cases.row(k, cases.prose(k, 20), "big" if k % 4 else "small") for k in range(4000)]
    docs = cases.documents(spark, data)
    rates = {r.mix_source: r.rate for r in repetition_rates(docs, {"big": 1.0, "small": 3.0}).collect()}
    assert rates["small"] > 2.5 and rates["big"] < 0.4
    mixed = mix(docs, {"big": 1.0, "small": 3.0}, seed=1).groupBy("source").sum("n_chars").collect()
    sums = {r.source: r[1] for r in mixed}
    assert abs(sums["small"] / sum(sums.values()) - 0.75) < 0.03


def test_no_python_rows_in_the_plan_of_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = kd_shards(docs, shards=5)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
    assert literal_rows(spark, [(1, "a", 2**60, 0.1)], "n INT, s STRING, b BIGINT, d DOUBLE").collect() == [(1, "a", 2**60, 0.1)]
