"""Parameter sweeps and reports: grids, deltas, pivots, gaps."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = {"comma": ", ", "ideographic": "、", "space": " ", "newline": "\n", "semicolon": "; "}


def grid(spark: SparkSession, **values: str) -> DataFrame:
    """Every combination of comma-separated values, one double column each; small by construction."""
    lists = [[float(x) for x in v.split(",") if x.strip()] for v in values.values()]
    return spark.createDataFrame(list(product(*lists)), ", ".join(f"{k} double" for k in values))


def cross(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Each row with each setting of a grid."""
    return rows.crossJoin(F.broadcast(small))


def delta_first(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    return rows.withColumn("delta", F.col(value) - F.first(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def delta_arm(rows: DataFrame, by: list[str], arm: str, value: str, base: str = "none") -> DataFrame:
    """Difference to the arm named ``base``; null where there is none."""
    return rows.withColumn("delta", F.col(value) - F.max(F.when(F.col(arm) == base, F.col(value))).over(Window.partitionBy(*by)))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order that leaves no ties open."""
    return rows.orderBy(*order).limit(n)


def matrix(rows: DataFrame, label: str, key: str, value: str, keys: list) -> DataFrame:
    return rows.groupBy(label).pivot(key, keys).agg(F.first(value))


def duplicate_outputs(rows: DataFrame, label: str, text: str) -> DataFrame:
    """Groups of labels whose texts are equal."""
    return rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(label)).alias("labels")).where("n > 1")


def deterministic(rows: DataFrame, by: str, text: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("runs"), (F.count_distinct(text) == 1).alias("deterministic"))


def gaps(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.groupBy(by).agg(F.min(d).alias("least"), F.max(d).alias("most"), F.avg(d).alias("mean"))


def prompts(terms: DataFrame, by: str, term: str, order: str) -> DataFrame:
    """Prompt variants of a term list: five separators, reversed, the last three; none for an empty list."""
    lists = terms.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, term))), lambda s: s[term]).alias("t"))
    variants = [(k, F.array_join("t", sep)) for k, sep in SEPARATORS.items()]
    variants += [("reversed", F.array_join(F.reverse("t"), ", ")), ("last3", F.array_join(F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), F.lit(3)), ", "))]
    return lists.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("prompt")) for k, v in variants))).alias("v")).select(by, "v.*")


def prompt_contents(rows: DataFrame, by: str, terms: Column, topic: Column, hint: Column, sep: str = ", ") -> DataFrame:
    """(by, variant, prompt): no prompt at all, once for each ``by``, and what terms, topic and a language hint give; what is empty is left out."""
    listed = F.when(F.size(terms) > 0, F.array_join(terms, sep))
    filled = lambda c: F.when(F.length(c) > 0, c)
    with_terms = lambda c: F.concat(filled(c), F.lit(" "), listed)
    variants = {"none": F.lit(""), "terms": listed, "topic": filled(topic), "topic_terms": with_terms(topic), "hint_terms": with_terms(hint)}
    each = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("prompt")) for k, v in variants.items()))
    return rows.select(by, F.explode(F.filter(each, lambda v: v["prompt"].isNotNull())).alias("v")).select(by, "v.*")


def prompt_fit(tokens: Column, capacity: int) -> Column:
    return F.struct(F.least(tokens, F.lit(capacity)).alias("kept"), (tokens > capacity).alias("truncated"))


def prompt_ids(begin: int, pad: int, delay: Column, extra: Column, capacity: int) -> Column:
    """Begin, the last ``capacity`` extra ids, then one pad for each delay step."""
    tail = F.when(F.size(extra) > capacity, F.slice(extra, -capacity, capacity)).otherwise(extra)
    return F.concat(F.array(F.lit(begin)), F.coalesce(tail, F.array().cast("array<int>")), F.array_repeat(F.lit(pad), delay))
