"""Prefix scans: what has happened before a row, without bringing the rows of a key into one task.

Rows are dealt into parts by ranges of (key, order).  What a part does to a running
value is summed up in one row a (key, part); an associative operation combines these
in a tree of FANOUT children a node, up and down again, which gives each part the
value it starts from.  A second pass runs inside the parts.  No step holds more rows of
a key than a part or FANOUT summaries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriva.operators.lineage import cut

FANOUT = 64
#: Parts a shuffle partition: a key's parts meet in a task by chance, so more of them deal more evenly.
FINER = 4

Combine = Callable[[Column, Column], Column]


def dealt(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with _part, ascending with (by, order), and the number of parts; cut, so that parts stay what they are."""
    n = parts or FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())), n


def before(summaries: DataFrame, by: list[str], at: str, summary: str, zero: Column, combine: Combine, parts: int, fanout: int = FANOUT) -> DataFrame:
    """(by, at, before): of each row the summaries of its key at smaller ``at`` (0 up to ``parts``), combined.

    ``combine`` is associative, ``zero`` its neutral value; one row a (by, at).
    """
    kind = summaries.schema[summary].dataType.simpleString()
    zero = zero.cast(kind)
    keys = [f"_k{k}" for k in range(len(by))]
    level = summaries.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(at).cast("bigint").alias("_g"), F.col(summary).alias("_s"))
    levels, n = [], parts
    while True:
        grouped = level.groupBy(*keys, F.floor(F.col("_g") / fanout).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_g", "_s"))).alias("_c"))
        levels.append(grouped)
        n = -(-n // fanout)
        if n <= 1:
            break
        level = grouped.select(*keys, F.col("_up").alias("_g"), F.aggregate("_c", zero, lambda acc, x: combine(acc, x["_s"]).cast(kind)).alias("_s"))
    down = None
    for grouped in reversed(levels):
        if down is None:
            rows = grouped.withColumn("_b", zero)
        else:
            same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_d{k}")) for k in keys), F.col("_up") == F.col("_dg"))
            rows = grouped.join(down.select(*(F.col(k).alias(f"_d{k}") for k in keys), F.col("_g").alias("_dg"), "_b").hint("merge"), same)
        run = F.aggregate(
            "_c", F.struct(F.array().cast(f"array<struct<_g:bigint,_b:{kind}>>").alias("out"), F.col("_b").alias("acc")),
            lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct(x["_g"].alias("_g"), acc["acc"].alias("_b")))).alias("out"), combine(acc["acc"], x["_s"]).cast(kind).alias("acc")),
        )
        down = rows.select(*keys, F.explode(run["out"]).alias("_e")).select(*keys, "_e._g", "_e._b")
    return down.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.col("_g").alias(at), F.col("_b").alias("before"))


def with_before(rows: DataFrame, parts: int, by: list[str], summary: Column, zero: Column, combine: Combine, name: str = "_before") -> DataFrame:
    """``dealt`` rows with the value that their part starts from; ``summary`` is an aggregate of a key's rows in a part."""
    each = rows.groupBy(*by, "_part").agg(summary.alias("_sum"))
    start = before(each, by, "_part", "_sum", zero, combine, parts).select(*(F.col(c).alias(f"_of{k}") for k, c in enumerate(by)), F.col("_part").alias("_of"), F.col("before").alias(name))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate(by)), F.col("_part") == F.col("_of"))
    return rows.join(start, same, "left").drop("_of", *(f"_of{k}" for k in range(len(by))))


def line(by: list[str], order: list[str]) -> Window:
    """The window of a key's rows inside their part."""
    return Window.partitionBy(*by, "_part").orderBy(*order)


def sum_before(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their key before them; 0 for the first, nulls add nothing."""
    held, n = dealt(rows.withColumn("_summed", F.coalesce(value, F.lit(0))), by, order, parts)
    held = with_before(held, n, by, F.sum("_summed"), F.lit(0), lambda a, b: a + b)
    inside = line(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn(name, F.col("_before") + F.coalesce(F.sum("_summed").over(inside), F.lit(0))).drop("_summed", "_before", "_part")


def number(rows: DataFrame, by: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` numbered from 0 inside their key; a row number of which no task holds a key."""
    return sum_before(rows, by, order, F.lit(1).cast("bigint"), name, parts)
