"""Exact quantiles of keys of any size.

A mergeable sketch gives each key values just below and just above every rank that is
asked for; exact counts say how many rows lie below, and only the few between are put
in order, as distinct values with their numbers, by a prefix scan.  No buffer holds a
key's values and no task its rows.

Nulls do not count; a key without values gives null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.operators import scan

#: A sketch is off by this share of a key's rows at most; what lies between two bounds is a few times that.
ACCURACY = 5_000


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Column]], accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, names): the values, as doubles, at ranks from 0 in ascending order.

    A name gives about which share of the values lies below, and the rank by the column ``n``.
    """
    rows = rows.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), F.col(value).cast("double").alias("_v"))
    keys = [f"_k{k}" for k in range(len(by))]
    wide = 3.0 / accuracy
    bound = lambda p: F.percentile_approx("_v", F.lit(min(max(p, 0.0), 1.0)), F.lit(accuracy))
    sketch = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *(f(p).alias(f"{side}{k}") for k, (p, _) in enumerate(ranks.values()) for side, f in (("a", lambda p: bound(p - wide)), ("b", lambda p: bound(p + wide)))))
    wanted = F.array(*(F.struct(F.lit(k).alias("q"), r.cast("bigint").alias("r"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k, (_, r) in enumerate(ranks.values())))
    wanted = sketch.where("n > 0").select(*(F.col(k).alias(f"{k}_") for k in keys), "_lo", "_hi", F.explode(wanted).alias("w")).select(*(f"{k}_" for k in keys), "_lo", "_hi", "w.*")
    same = lambda: reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys), F.lit(True))
    counted = rows.where("_v is not null").join(wanted, same()).groupBy(*(f"{k}_" for k in keys), "q", "r", "a", "b", "_lo", "_hi").agg(F.count_if(F.col("_v") < F.col("a")).alias("below"), F.count_if(F.col("_v") <= F.col("b")).alias("upto"))
    held = (F.col("below") <= F.col("r")) & (F.col("r") < F.col("upto"))  # else the sketch is off, and all values are put in order
    ranges = counted.select(*(f"{k}_" for k in keys), "q", "r", *(F.when(held, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "_lo"), ("b", "_hi"))), F.when(held, F.col("below")).otherwise(F.lit(0)).alias("below"))
    inside = rows.join(ranges, same() & F.col("_v").between(F.col("a"), F.col("b"))).groupBy(*keys, "q", "r", "below", "_v").agg(F.count("*").alias("m"))
    placed = scan.sum_before(inside, [*keys, "q"], ["_v"], F.col("m"), "s")
    found = placed.where((F.col("below") + F.col("s") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("s") + F.col("m")))
    values = found.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(*(F.max(F.when(F.col("q") == k, F.col("_v"))).alias(name) for k, name in enumerate(ranks)))
    return sketch.select(*keys, "n").join(values, same(), "left").select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "n", *ranks)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, names): quantiles by linear interpolation between the two values around each."""
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = {f"{name}_{side}": (p, f(place(p))) for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = at_ranks(rows, by, value, ranks, accuracy)
    part = lambda p: place(p) - F.floor(place(p))
    return found.select(*by, "n", *((F.col(f"{x}_lo") + (F.col(f"{x}_hi") - F.col(f"{x}_lo")) * part(p)).alias(x) for x, p in shares.items()))
