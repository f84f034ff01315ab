"""Shards: every row once, equal numbers, the order that the two passes give done by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.llm import shards as S

SCHEMA = "doc_id long, text string, h1 string, bucket int, slot string"


def made(n, rng):
    rows = [(i, "é" * rng.randint(0, 40), "clash", 1, "old") for i in range(n)]
    return rows + [(None, "x", None, None, None), (3, None, "a", 1, "old"), (3, None, "a", 1, "old"), (5, "", "a", 1, "old"), (6, "w " * 200_000, "b", 2, None)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r.shard, r.slot))


@pytest.mark.parametrize("n,shards,bucket_bytes", [(0, 40, 1 << 20), (20, 40, 1 << 20), (300, 7, 1 << 20), (300, 7, 500)])
def test_all_rows_are_in_equal_shards(spark, tmp_path, n, shards, bucket_bytes):
    rows = made(n, random.Random(1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = S.write_shards(docs, str(tmp_path / "s"), shards=shards, bucket_bytes=bucket_bytes)
    assert got.columns == ["doc_id", "text", "h1", "bucket", "shard", "slot"] or set(got.columns) == {"doc_id", "text", "h1", "bucket", "shard", "slot"}
    got = got.collect()
    assert Counter((r.doc_id, r.text, r.h1, r.bucket) for r in got) == Counter(r[:4] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 1
    for k, m in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(m))
    again = S.write_shards(docs.repartition(2), str(tmp_path / "t"), shards=shards, bucket_bytes=bucket_bytes).collect()
    assert in_order(got) == in_order(again)  # whatever the partitions


def test_order_is_that_of_buckets_shuffled_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    got = in_order(S.write_shards(docs, str(tmp_path / "s"), shards=9, seed=3, bucket_bytes=1500).collect())
    hashed = docs.select("doc_id", F.octet_length("text").alias("size"), S._hash(3, docs.columns).alias("h1"), S._hash(4, docs.columns).alias("h2")).collect()
    buckets = -(-sum(r["size"] + 16 for r in hashed) // 1500)
    want = []
    for b in range(buckets):
        own = sorted((r for r in hashed if r.h1 % buckets == b), key=lambda r: (r.h1, r.h2))
        want += [own[i].doc_id for i in S.fisher_yates(3, b, len(own))]
    assert buckets > 5 and [r.doc_id for r in got] == want
    assert abs(np.corrcoef(want, range(500))[0, 1]) < 0.15


def test_a_record_repeated_very_often_is_scattered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RUN", 30)
    docs = spark.createDataFrame([(i, "some text") for i in range(200)] + [(7, "the same")] * 100, "doc_id long, text string")
    got = S.write_shards(docs, str(tmp_path / "s"), shards=10, bucket_bytes=1000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(i, "some text") for i in range(200)] + [(7, "the same")] * 100)
    each = Counter(r.shard for r in got if r.text == "the same")
    assert set(Counter(r.shard for r in got).values()) == {30} and max(each.values()) < 20 and len(each) == 10


def test_every_order_is_as_likely():
    seen = Counter(tuple(S.fisher_yates(7, b, 3)) for b in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())


def test_cuts_have_no_gaps():
    for rows in (0, 1, 39, 40, 41, 400, 1234):
        shard, slot = S.cut_at(np.arange(rows), rows, 40)
        assert list(shard) == sorted(shard) and all(list(slot[shard == k]) == list(range((shard == k).sum())) for k in range(40))
