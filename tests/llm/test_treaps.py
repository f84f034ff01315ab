"""Ranked search: walks against sums over all postings, the query against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skriva.llm import treaps as T


def summed(lists, plan, floor, k):
    out = []
    for q in sorted({p[0] for p in plan}):
        scores = Counter()
        for _, s, w in (p for p in plan if p[0] == q):
            for d, v in lists[s]:
                scores[d] += w * v
        out += [(q, d, v) for d, v in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k] if v > 0 and v >= floor[q]]
    return sorted(out)


def test_walks_find_the_best_of_all_postings():
    rng = random.Random(3)
    for _ in range(150):
        n_docs, n_lists, k = rng.choice([1, 2, 5, 40, 300]), rng.randint(1, 8), rng.choice([1, 3, 10])
        lists = [[(d, rng.randint(1, rng.choice([2, 5, 100]))) for d in sorted(rng.sample(range(n_docs), rng.randint(1, n_docs)))] for _ in range(n_lists)]
        plan = [(q, s, rng.randint(1, 3)) for q in range(rng.randint(1, 4)) for s in rng.sample(range(n_lists), rng.randint(1, n_lists))]
        floor = np.array([rng.choice([0, 0, 3]) for _ in range(4)])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        doc, impact = (np.array([p[i] for x in lists for p in x]) for i in (0, 1))
        q, s, w = np.array(plan).T
        got = T.walk(T.Lists(starts, doc, impact, n_docs), q, s, w, floor, k)
        assert sorted(zip(*(x.tolist() for x in got[:3]), strict=True)) == summed(lists, plan, floor, k)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(1)
    starts = np.array([0, 1, 1, 60, 100])
    impact = rng.integers(1, 6, 100)
    left, right, root = T.treaps(starts, impact)
    for k in range(4):
        seen, todo = [], [(root[k], 10**9)]

        def visit(node, above, seen=seen):
            if node == 100:
                return
            assert impact[node] <= above
            visit(left[node], impact[node])
            seen.append(node)
            visit(right[node], impact[node])

        visit(*todo[0])
        assert seen == list(range(starts[k], starts[k + 1]))


def test_most_documents_are_not_scored():
    rng = np.random.default_rng(2)
    n = 20_000
    starts, doc = np.array([0, n, 2 * n]), np.tile(np.arange(n), 2)
    impact = (1000 / rng.uniform(0.01, 1, 2 * n)).astype(np.int64)
    *_, scored = T.walk(T.Lists(starts, doc, impact, n), np.zeros(2, np.int64), np.arange(2), np.ones(2, np.int64), np.zeros(1, np.int64), 10)
    assert scored < n / 20


def ranked(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(words(t))) for i, t in docs if i is not None]
    big_n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, terms in asked.items():
        rows = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * big_n // max(total, 1)
            s = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, n in terms.items() if w in c)
            if s > 0:
                rows.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes,turn_rows", [(1 << 20, 1000), (200, 5)])
def test_search_ranks_all_documents(spark, tmp_path, block_bytes, turn_rows):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Ünder", "X9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in rng.sample(range(1000), 120)]
    docs += [(docs[0][0], docs[0][1]), (docs[1][0], "w1 w2"), (None, "w1 w1"), (7001, None), (7002, ""), (7003, "W1-w1\x00ÉTÉ"), *((8000 + i, "w5 w6 w7 w5") for i in range(30)), (9000, "w3 " * 60_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(9)] + [(100, None), (101, "zz qq"), (None, "w1"), (102, "w5 w5 w6"), (102, "w7"), (103, "w3 w1")]
    table = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, text string, block int, term string, tf double").repartition(3)
    lists = T.index(table, str(tmp_path / "i"), block_bytes=block_bytes)
    got = T.search(lists, spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, score int"), turn_rows=turn_rows).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == ranked(docs, items)


def test_search_takes_empty_tables(spark, tmp_path):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "x y")], items.schema)
    assert T.search(T.index(docs, str(tmp_path / "a")), some).count() == 0
    assert T.search(T.index(spark.createDataFrame([(1, "x")], docs.schema), str(tmp_path / "b")), items).count() == 0
    (one,) = T.search(T.index(spark.createDataFrame([(1, "x")], docs.schema), str(tmp_path / "c")), some).collect()
    assert (one.item_id, one.doc_id) == ("a", 1)
