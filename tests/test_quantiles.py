"""Exact quantiles of uneven keys against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.operators import quantiles


@pytest.mark.parametrize("accuracy", [10, 200, 5000])
def test_quantiles_are_those_of_sorted_values(spark, accuracy):
    """With a poor sketch more values lie between the bounds; the result is the same."""
    rng = random.Random(accuracy)
    kinds = {"hot": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])), "tail": lambda: 10 ** rng.uniform(-9, 300), None: lambda: float(rng.randrange(50))}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(4000 if k == "hot" else 300)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("two", None), ("none", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = {"q0": 0.0, "low": 0.025, "mid": 0.5, "p95": 0.95, "q1": 1.0}
    got = {r.k: r for r in quantiles.quantiles(frame, ["k"], "v", shares, accuracy).collect()}
    assert got["none"].n == 0 and got["none"].mid is None and len(got) == 7
    for k in {k for k, _ in rows} - {"none"}:
        own = [v for q, v in rows if q == k and v is not None]
        assert got[k].n == len(own)
        for name, p in shares.items():
            assert getattr(got[k], name) == pytest.approx(float(np.quantile(own, p)), rel=1e-12)


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(100)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "k int, v int")
    got = quantiles.at_ranks(frame, ["k"], "v", {"upper": (0.5, F.floor(F.col("n") / 2)), "nearest": (0.95, F.bround(F.lit(0.95) * (F.col("n") - 1)))}).collect()
    for r in got:
        own = sorted(v for k, v in rows if k == r.k)
        assert (r.upper, r.nearest) == (own[len(own) // 2], own[round(0.95 * (len(own) - 1))])
    assert quantiles.quantiles(frame.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_a_hot_key_is_not_held_by_a_buffer(spark):
    """No percentile or collected list in the plan, and few rows to put in order."""
    frame = spark.range(200_000).select(F.lit("k").alias("k"), F.rand(3).alias("v"))
    got = quantiles.quantiles(frame, ["k"], "v", {"m": 0.5})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list(_v" not in plan
    (r,) = got.collect()
    assert r.n == 200_000 and abs(r.m - 0.5) < 0.01
