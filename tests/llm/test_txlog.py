"""Transaction logs against a reader that goes through the log once."""

import random
from collections import Counter

import pytest

from skriva.llm import txlog as T

OPS = ["commit", "abort", "savepoint", "rollback", "change"]
SCHEMA = "at long, source string, op string, key long, value long"


def order(r):
    at, source, op, key, value = r
    return (at, "" if source is None else "=" + source, op, -1 if key is None else key, -1 if value is None else value)


def by_one_pass(log, every):
    stacks, fates, store, states, commits = {}, [], {}, [], 0
    for at, source, op, key, value in sorted((r for r in log if r[0] is not None and r[2] in OPS), key=order):
        stack = stacks.setdefault(source, [[]])
        if op == "change":
            stack[-1].append((at, key, value))
        elif op == "savepoint":
            stack.append([])
        elif op == "rollback":
            fates += [("rollback", a, at, k) for a, k, _ in stack.pop()]
            if not stack:
                stack.append([])
        else:
            for a, k, v in (x for s in stack for x in s):
                if op == "commit":
                    store[k] = v
                else:
                    fates.append(("abort", a, at, k))
            stacks[source] = [[]]
            if op == "commit":
                commits += 1
                if commits % every == 0:
                    states.append(dict(store))
    if commits % every:
        states.append(dict(store))
    fates += [("abort", a, None, k) for stack in stacks.values() for s in stack for a, k, _ in s]
    return Counter(fates), [(i, sum(v is not None for v in s.values()), sum(v or 0 for v in s.values())) for i, s in enumerate(states, 1)]


def check(spark, log, every=4, block=T.EPOCH_BLOCK, **options):
    changes, commits = T.resolve(spark.createDataFrame(log, SCHEMA).repartition(3), **options)
    got = Counter((r.fate, r.at, r.by_at, r.key) for r in changes.where("fate <> 'commit'").collect())
    states = sorted(tuple(r) for r in T.states(changes, commits, every, block).collect())
    assert (got, states) == by_one_pass(log, every)


def made(rng, n, sources, weights):
    return [(i, rng.choice(sources), op, rng.randrange(6) if op == "change" else None, rng.choice([None, *range(1, 50)]) if op == "change" else None) for i, op in enumerate(rng.choices(OPS, weights, k=n))]


@pytest.mark.parametrize(
    "weights,sources",
    [([2, 1, 2, 2, 16], ["a", "b", None, ""]), ([1, 0, 60, 60, 60], ["a"]), ([0, 0, 3, 2, 5], ["a", "b"]), ([0, 1, 9, 2, 9], ["a"] * 9 + ["b"]), ([30, 1, 1, 1, 40], ["a", "b"])],
)
def test_logs_in_many_chunks(spark, weights, sources):
    """With many savepoints and few ends, segments wait for chunks far behind them."""
    rng = random.Random(len(sources) + sum(weights))
    check(spark, made(rng, 700, sources, weights), every=3, block=4, chunk_rows=15)


def test_chunks_of_one_record_by_a_scan_of_more_levels(spark, monkeypatch):
    from skriva.operators import scan

    monkeypatch.setattr(scan.before, "__defaults__", (3,))
    check(spark, made(random.Random(8), 60, ["a", None], [1, 1, 5, 5, 9]), chunk_rows=1, block=2)


def test_odd_logs(spark):
    check(spark, [])
    check(spark, [(None, "a", "change", 1, 1), (1, "a", "other", 1, 1), (2, None, "rollback", None, None)])
    check(spark, [(1, "a", "commit", None, None)] * 9, every=4)  # empty commits
    twice = [(1, "a", "change", 5, 7), (1, "a", "change", 5, 7), (2, "b", "change", 5, None), (3, "a", "commit", None, None), (3, "a", "commit", None, None), (4, "b", "commit", None, None)]
    check(spark, twice, every=1)


def test_documents_as_a_log(spark):
    docs = spark.createDataFrame([(i, f"é{i}" if i % 9 else None, "s" if i % 3 else None, 1, "x") for i in range(400)] + [(None, "x", "s", 1, "x")], "doc_id long, text string, source string, op int, key string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(0, 400, 5)] * 2, "doc_id long, toxic int")
    import zlib

    h = lambda i: zlib.crc32(str(i).encode())
    kind = lambda x: "commit" if x < 2 else "abort" if x == 2 else "savepoint" if x < 5 else "rollback" if x < 7 else "change"
    toxic = {i for i in range(0, 400, 5) if i % 2}
    want = []
    for i in range(400):
        op, key = kind(h(i) % 23), h(i) // 100 % 300
        value = zlib.crc32(f"{key}:é{i}".encode()) if i % 9 and i not in toxic else None
        want.append((i, "s" if i % 3 else None, op, key if op == "change" else None, value if op == "change" else None))
    assert sorted(map(tuple, T.document_log(docs, labels).where("at is not null").collect()), key=order) == sorted(want, key=order)
