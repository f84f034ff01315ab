"""What a run decides about its files and how its results are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriva.functions import text
from skriva.operators import align


def language_skips(files: DataFrame, ref: str = "ref") -> DataFrame:
    """``files`` with skipped and reason, for a model that knows only languages written without spaces.

    A null or empty reference is not skipped.
    """
    spaced = text.is_space_delimited(F.col(ref))
    return files.withColumn("skipped", spaced).withColumn("reason", F.when(spaced, "reference is space-delimited"))


def mixed_scripts(files: DataFrame, by: str, ref: str = "ref", forced: Column | None = None) -> DataFrame:
    """(by, units, refused): one forced language for a set of files that holds both kinds of script is refused."""
    asked = F.lit(True) if forced is None else forced
    return files.groupBy(by).agg(F.array_sort(F.collect_set(text.unit_of(F.col(ref)))).alias("units"), F.max(asked).alias("_asked")).select(by, "units", ((F.size("units") > 1) & F.coalesce("_asked", F.lit(False))).alias("refused"))


def ranked(rows: DataFrame, label: str, metric: str, by: list[str] | None = None) -> DataFrame:
    """With place: the least metric first, equal ones by label, unknown ones last."""
    line = Window.partitionBy(*(by or [])).orderBy(F.asc_nulls_last(metric), label)
    return rows.withColumn("place", F.row_number().over(line).cast("bigint"))


def previous_text(chunks: DataFrame, by: str, order: str = "chunk_idx", said: str = "text", most: int = 200) -> DataFrame:
    """With context: the end of what the chunk before said, null for the first (the second pass of context carry)."""
    before = F.lag(said).over(Window.partitionBy(by).orderBy(order))
    return chunks.withColumn("context", F.substr(before, F.greatest(F.length(before) - most, F.lit(0)) + 1))


def flagged(rows: DataFrame, by: str, flag: str | Column, name: str, n: int = 10) -> DataFrame:
    """(by, count, first): how many rows have a flag, and the names of the first ``n``."""
    mark = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    seen = rows.select(by, F.col(name).alias("_name"), mark.alias("_mark"))
    counted = seen.groupBy(by).agg(F.count_if("_mark").alias("count"))
    line = Window.partitionBy(by).orderBy("_name")
    first = seen.where("_mark").withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= n).groupBy(by).agg(F.array_sort(F.collect_list("_name")).alias("first"))
    return counted.join(first, by, "left").withColumn("first", F.coalesce("first", F.array().cast(first.schema["first"].dataType)))


def lenient_regions(scored: DataFrame, key: str, errors: str = "lenient_errors", regions: int = 40) -> DataFrame:
    """``align.region_errors`` of pairs that also have ``errors``, each pair's edits scaled to that total."""
    counted = align.region_errors(scored, key, regions)
    total = counted.groupBy(key).agg(F.sum("edits").alias("_all"))
    scale = scored.select(key, F.col(errors).alias("_kept")).join(total, key)
    return counted.join(scale, key).select(key, "region", "ref_len", (F.col("edits") * F.col("_kept") / F.greatest("_all", F.lit(1))).alias("edits"))
