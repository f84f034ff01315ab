"""Joins that Spark has no operator for: as-of, band and greedy one-to-one.

None of them compares every row with every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriva.operators import scan


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str], first_if_before: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last right row whose time is not after its own (inclusive).

    Both sides are lined up in time order in parts (``scan``); inside a part the last right row is
    carried forward, into it comes the last one of all earlier parts.  With ``first_if_before`` a left row before all right rows takes the first.
    """
    l = left.select(F.struct(*left.columns).alias("_l"), *by, F.col(left_on).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"))
    r = right.select(F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), *by, F.col(right_on).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    order = ["_t", "_side"]
    held, parts = scan.dealt(l.unionByName(r), by, order)
    rows = scan.with_before(held, parts, by, F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))), F.lit(None), lambda a, b: F.coalesce(b, a))
    here = F.last("_v", ignorenulls=True).over(scan.line(by, order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_last", F.coalesce(here, "_before")).where("_side = 1")
    if first_if_before:  # one row a key: the first of the right side
        first = held.where("_side = 0").groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.min_by("_v", "_t").alias("_first"))
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)))
        rows = rows.join(first, same, "left").withColumn("_last", F.coalesce("_last", "_first"))
    return rows.select("_l.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def band(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tol: float, by: list[str]) -> DataFrame:
    """Pairs with equal ``by`` and |left - right| <= tol: bins of width tol, the right side in its own and both neighbours."""
    bin_of = lambda c: F.floor(F.col(c) / F.lit(tol)).cast("bigint")
    l = left.withColumn("_bin", bin_of(left_on))
    r = right.withColumn("_b", bin_of(right_on)).withColumn("_bin", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    return l.join(r, [*by, "_bin"]).where(F.abs(F.col(left_on) - F.col(right_on)) <= tol).drop("_bin")


def greedy(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """One-to-one matches among candidate pairs, nearest first, then by a, then b; uniqueness is by value.

    Pairs are sorted by Spark and read as a stream; of a key only the values used so far are held.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used_a, used_b = None, set(), set()
        for batch in batches:
            kept = []
            for n, (k, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if k != key:
                    key, used_a, used_b = k, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    kept.append(n)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = pairs.select(by, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    return rows.repartition(by).sortWithinPartitions(by, F.abs(F.col(a) - F.col(b)), a, b).mapInArrow(match, rows.schema)
