"""Corpus statistics over result rows: weighted rates, paired comparisons, resampling, tests.

Resampling draws come from a hash of (seed, resample, slot), so every engine and every
retry draws alike, and both arms of a comparison share their draws.
"""

from __future__ import annotations

from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skriva.operators import scan

#: Two-sided 95 % points of Student's t by degrees of freedom.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042}


def weighted_rate(error: Column, weight: Column) -> Column:
    """Length-weighted mean: a ratio of sums."""
    return F.sum(error * weight) / F.sum(weight)


def throughput(audio_s: Column, wall_s: Column) -> Column:
    return F.sum(audio_s) / F.greatest(F.sum(wall_s), F.lit(1e-9))


def first_of_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order (keep last: order descending)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def paired(a: DataFrame, b: DataFrame, key: list[str], weight: str = "ref_units", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(pairs with weight, ea, eb; pairs set aside because the reference lengths differ)."""
    both = a.select(*key, F.col(weight).alias("wa"), F.col(error).alias("ea")).join(b.select(*key, F.col(weight).alias("wb"), F.col(error).alias("eb")), key)
    same = F.col("wa") == F.col("wb")
    return both.where(same).select(*key, F.col("wa").alias("weight"), "ea", "eb"), both.where(~same)


def unmatched(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, side) of rows that only one run has."""
    one = lambda x, y, side: x.select(*key).distinct().join(y.select(*key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "a").unionByName(one(b, a, "b"))


def draw(seed: int, boot: Column, slot: Column, n: Column) -> Column:
    """A draw from 0..n-1 by the first 32 bits of an md5."""
    key = F.concat_ws(":", F.lit(str(seed)), boot.cast("string"), slot.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n).cast("bigint")


def bootstrap(pairs: DataFrame, unit: str, order: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(unit, boot_id, diff): length-weighted difference of both arms over files drawn with replacement.

    ``pairs`` has weight, ea, eb.  The files of a unit are numbered; draws meet them by an
    equi-join on (unit, number).  A resample has as many draws as the unit has files; ``poisson_bootstrap``
    sums them up where they are.
    """
    spark = pairs.sparkSession
    numbered = scan.number(pairs, [unit], order, "_i")
    sizes = numbered.groupBy(unit).agg(F.count("*").alias("_n"))
    draws = sizes.crossJoin(spark.range(n_boot).withColumnRenamed("id", "boot_id")).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    draws = draws.withColumn("_i", draw(seed, F.col("boot_id"), F.col("_slot"), F.col("_n"))).select(unit, "boot_id", "_i")
    rows = draws.join(numbered, [unit, "_i"])
    return rows.groupBy(unit, "boot_id").agg((weighted_rate(F.col("ea"), F.col("weight")) - weighted_rate(F.col("eb"), F.col("weight"))).alias("diff"))


#: How often a file is drawn in a Poisson resample: the distribution function of a rate of one.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217]


def poisson_bootstrap(pairs: DataFrame, unit: str, ids: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(unit, boot_id, diff): ``bootstrap`` for corpora of any size.

    Each file draws by itself how often it is in a resample (a rate of one), so files need
    no numbers, nothing is joined, and rows are summed up before they move.
    """
    boots = pairs.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("boot_id").cast("string"), *(F.col(c).cast("string") for c in ids))
    u = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 32))
    times = sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(u >= _POISSON[0], 1).otherwise(0))
    rows = boots.withColumn("_w", times * F.col("weight")).where("_w > 0")
    return rows.groupBy(unit, "boot_id").agg((weighted_rate(F.col("ea"), F.col("_w")) - weighted_rate(F.col("eb"), F.col("_w"))).alias("diff"))


def interval(draws: DataFrame, by: str, value: str = "diff") -> DataFrame:
    """Percentile interval (interpolated) and the share of draws over zero."""
    return draws.groupBy(by).agg(F.expr(f"percentile({value}, 0.025)").alias("lo"), F.expr(f"percentile({value}, 0.975)").alias("hi"), F.avg((F.col(value) > 0).cast("double")).alias("favour"))


def block_bootstrap(per_pos: DataFrame, by: str, pos: str, errors: str, n_boot: int = 400, block: int = 200, seed: int = 0) -> DataFrame:
    """(by, lo, hi) of the error rate by moving blocks; null under two blocks.

    Errors are summed up once; a block is the difference of two sums, found by an
    equi-join on its ends.
    """
    spark = per_pos.sparkSession
    sums = scan.sum_before(per_pos.select(by, F.col(pos).cast("bigint").alias("_p"), F.col(errors).alias("_e")), [by], ["_p"], F.col("_e"), "_sum")
    sums = sums.select(by, "_p", (F.col("_sum") + F.coalesce("_e", F.lit(0))).alias("_sum"))
    n = per_pos.groupBy(by).agg(F.count("*").alias("_n")).withColumn("_k", F.floor(F.col("_n") / block).cast("bigint"))
    draws = n.where(F.col("_n") >= 2 * block).crossJoin(spark.range(n_boot).withColumnRenamed("id", "boot_id")).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    draws = draws.withColumn("_s", draw(seed, F.col("boot_id"), F.col("_slot"), F.col("_n") - block))
    # the sum before position s is the sum up to s - 1; before 0 it is 0
    ends = draws.select(by, "boot_id", "_k", F.explode(F.array(F.struct((F.col("_s") + block - 1).alias("_p"), F.lit(1).alias("_w")), F.struct((F.col("_s") - 1).alias("_p"), F.lit(-1).alias("_w")))).alias("e"))
    rows = ends.select(by, "boot_id", "_k", "e._p", "e._w").join(sums, [by, "_p"], "left")
    rates = rows.groupBy(by, "boot_id").agg((F.sum(F.col("_w") * F.coalesce("_sum", F.lit(0))) / (F.max("_k") * block)).alias("rate"))
    out = rates.groupBy(by).agg(F.expr("percentile(rate, 0.025)").alias("lo"), F.expr("percentile(rate, 0.975)").alias("hi"))
    return n.select(by).join(out, by, "left")


@F.pandas_udf(T.DoubleType())
def sign_test_p(wins_a: pd.Series, wins_b: pd.Series) -> pd.Series:
    """Two-sided exact sign test; ties do not count, nothing to count gives 1."""

    def p(a: int, b: int) -> float:
        n = a + b
        return min(1.0, 2 * sum(comb(n, i) for i in range(min(a, b) + 1)) / 2**n) if n else 1.0

    return pd.Series([p(int(a), int(b)) for a, b in zip(wins_a, wins_b, strict=True)])


@F.pandas_udf(T.StringType())
def distinct_resamples(n: pd.Series) -> pd.Series:
    """C(2n-1, n), exact, as decimal digits (it outgrows 64 bits from n = 34)."""
    return n.map(lambda k: str(comb(2 * int(k) - 1, int(k))) if k > 0 else "0")


def wins(pairs: DataFrame, by: str) -> DataFrame:
    """(by, wins_a, wins_b, n): the lower error wins, strictly."""
    return pairs.groupBy(by).agg(F.count_if(F.col("ea") < F.col("eb")).alias("wins_a"), F.count_if(F.col("eb") < F.col("ea")).alias("wins_b"), F.count("*").alias("n"))


def t_critical(df: Column) -> Column:
    """From the table, down to its nearest entry; the normal point beyond it."""
    out = F.lit(1.96)
    for k in sorted(T_95, reverse=True):
        out = F.when(df <= max(T_95), F.when(df >= k, T_95[k])).otherwise(1.96) if k == max(T_95) else F.coalesce(out, F.when(df >= k, T_95[k]))
    return F.coalesce(out, F.lit(T_95[1]))


def t_interval(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, sample deviation and 95 % interval of repeated runs."""
    stats = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    half = t_critical(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return stats.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def verdict(lo: Column, hi: Column, baseline: Column | float = 0.0) -> Column:
    """Below, above, or not resolved: the interval holds the baseline."""
    b = baseline if isinstance(baseline, Column) else F.lit(baseline)
    return F.when(hi < b, "below").when(lo > b, "above").otherwise("not resolved")


def block_rate(steps: DataFrame, by: str, step: str, seconds: str, block: int) -> DataFrame:
    """(by, block, rate): steps a second of each full block of steps."""
    rows = steps.groupBy(by, F.floor(F.col(step) / block).alias("block")).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    return rows.where(F.col("n") == block).select(by, "block", (F.lit(float(block)) / F.col("s")).alias("rate"))


def rank_stability(rows: DataFrame, threshold: str, label: str, value: str) -> DataFrame:
    """One row: how many orders of labels the thresholds give, and whether it is one."""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(value, label))), lambda s: s[label].cast("string")), ",")
    return rows.groupBy(threshold).agg(order.alias("ranking")).agg(F.count_distinct("ranking").alias("orders")).withColumn("stable", F.col("orders") == 1)


def projected_hours(corpus_hours: Column | float, x_realtime: Column) -> Column:
    """How long a corpus takes at a measured speed; null where nothing was measured."""
    h = corpus_hours if isinstance(corpus_hours, Column) else F.lit(corpus_hours)
    return F.when(x_realtime > 0, h / x_realtime)
