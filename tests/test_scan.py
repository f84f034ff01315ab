"""Prefix scans against one pass, also where one key has all rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skriva.operators import chunking, joins, scan, stats, timing
from skriva.plans.catalogue import QUERIES


@pytest.mark.parametrize("fanout,parts", [(2, 17), (3, 1), (64, 17)])
def test_before_is_what_one_pass_gives(spark, fanout, parts):
    """Strings put together: associative, and not the same the other way round."""
    rng = random.Random(fanout)
    rows = [(k, p, chr(97 + rng.randrange(26))) for k in ("a", "b", None) for p in sorted(rng.sample(range(parts), min(parts, rng.randint(1, 12))))]
    got = scan.before(spark.createDataFrame(rows, "k string, p int, s string"), ["k"], "p", "s", F.lit(""), lambda a, b: F.concat(a, b), parts, fanout)
    want = [(k, p, "".join(s for q, r, s in rows if q == k and r < p)) for k, p, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_sums_before_rows_of_one_key(spark):
    rng = random.Random(1)
    rows = [("one" if rng.random() < 0.9 else None, i, rng.choice([None, *range(9)])) for i in range(2000)]
    got = scan.sum_before(spark.createDataFrame(rows, "k string, i int, v long").repartition(7), ["k"], ["i"], F.col("v"), "s").collect()
    total, want = {}, []
    for k, i, v in rows:
        want.append((k, i, v, total.get(k, 0)))
        total[k] = total.get(k, 0) + (v or 0)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert scan.sum_before(spark.createDataFrame([], "k string, i int, v long"), ["k"], ["i"], F.col("v"), "s").count() == 0


def test_no_task_holds_a_key(spark):
    """The shuffle that brings a part's rows together deals one key over the tasks."""
    rows = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("i"))
    held, parts = scan.dealt(rows, ["k"], ["i"], parts=32)
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert parts == 32 and len(sizes) > 24 and max(sizes) < 2 * 20_000 / len(sizes)
    tasks = held.repartition(4, "k", "_part").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) <= 2 * 20_000 / 4


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_frames_of_one_file(spark, partitions):
    """Silence and the time map of a line that is cut into many parts, against a pass over it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        line, level = [], 0.0
        while len(line) < 600:
            level = -80.0 if level == 0.0 else 0.0
            line += [level] * rng.choice([1, 2, 4, 5, 9, 60])
        frames = chunking.silence_frames(spark.createDataFrame([("f", i, v) for i, v in enumerate(line)], "file string, i int, db double"), "file", "i", "db")
        got = [(r.i, r.quiet, r.run, r.run_len, r.in_run, r.keep) for r in frames.orderBy("i").collect()]
        want, kept = [], []
        for n, (quiet, run) in enumerate(groupby(enumerate(line), key=lambda x: x[1] < 0), 1):
            run = list(run)
            for k, (i, _) in enumerate(run, 1):
                want.append((i, quiet, n, len(run), k, not (quiet and len(run) >= 5 and k > 3)))
                kept.append(want[-1][-1])
        assert got == want
        starts = [i for i, k in enumerate(kept) if k and not (i and kept[i - 1])]
        mapped = chunking.time_map(frames, "file", "i", 1.0).orderBy("old_start_s").collect()
        assert [(r.new_start_s, r.old_start_s) for r in mapped] == [(float(sum(kept[:i])), float(i)) for i in starts]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_asof_over_many_parts(spark):
    rng = random.Random(4)
    left = [("k", rng.randrange(4000) / 2) for _ in range(800)]
    right = [("k", float(t), t) for t in sorted(rng.sample(range(5, 2000), 30))]
    a, b = spark.createDataFrame(left, "k string, t double"), spark.createDataFrame(right, "k string, at double, v int")
    latest = lambda t: max((v for _, at, v in right if at <= t), default=None)
    assert sorted((r.t, r.v) for r in joins.asof(a, b, "t", "at", ["k"], ["v"], first_if_before=True).collect()) == sorted((t, latest(t) if latest(t) is not None else right[0][2]) for _, t in left)
    assert sorted((r.t, -1 if r.v is None else r.v) for r in joins.asof(a, b, "t", "at", ["k"], ["v"]).collect()) == sorted((t, -1 if latest(t) is None else latest(t)) for _, t in left)


def test_characters_are_numbered_through_cues(spark):
    cues = spark.createDataFrame([("f", i, float(i), i + 1.0, "ab"[: i % 3] + "c" * (i % 2)) for i in range(200)], "file_id string, cue_idx int, start_s double, end_s double, text string")
    got = timing.timeline(cues).orderBy("char_pos").collect()
    assert [r.char_pos for r in got] == list(range(len(got))) and "".join(r.ch for r in got) == "".join("ab"[: i % 3] + "c" * (i % 2) for i in range(200))


def test_block_sums_of_one_long_line(spark):
    errors = [(("f", i, int(i % 7 == 0))) for i in range(1500)]
    got = stats.block_bootstrap(spark.createDataFrame(errors, "f string, i int, e int"), "f", "i", "e", n_boot=20, block=100).collect()
    assert len(got) == 1 and abs(got[0].lo - 1 / 7) < 0.02 and abs(got[0].hi - 1 / 7) < 0.02


def test_rows_are_numbered_through_parts(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 4001).alias("o"))
    got = scan.number(rows, ["k"], ["o"], "n", parts=16)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("query", ["block_rate", "block_bootstrap"])
def test_queries_over_few_keys_number_rows_in_parts(spark, query):
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in w.split("specifiedwindowframe")[0] for w in plan.split("windowspecdefinition(")[1:]), plan
