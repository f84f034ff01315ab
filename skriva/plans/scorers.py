"""Scores of one pair of files, as one-row DataFrames (what the command line prints)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions import kana as kana_functions
from skriva.functions import text
from skriva.operators import align, timing
from skriva.sources import transcripts

METRICS = ("cer", "coverage", "coverage_kana", "kana", "lenient", "timing")


def _pair(spark: SparkSession, ref: str, hyp: str) -> DataFrame:
    one = lambda path, name: transcripts.references(transcripts.texts(spark, path)).select(F.col("text").alias(name))
    return one(ref, "ref").crossJoin(one(hyp, "hyp"))  # one row each


def coverage(spark: SparkSession, ref: str, hyp: str, **options) -> DataFrame:
    """Unit and coverage counts of a hypothesis file, with a note where the reference was edited."""
    got = align.score_pairs(_pair(spark, ref, hyp), **options)
    return got.withColumn("edited_reference", F.col("extra_ratio") > 1.15).drop("ref", "hyp", "ops")


def cer(spark: SparkSession, ref: str, hyp: str, unit: str = "auto") -> DataFrame:
    """Plain error rate by characters or words; the unit is that of the reference's script."""
    got = align.score_pairs(_pair(spark, ref, hyp), unit=unit)
    return got.select("unit", "ref_units", "hyp_units", F.col("error_rate").alias("error"))


def kana(spark: SparkSession, ref: str, hyp: str, **options) -> DataFrame:
    """Character error rate on readings; null on spaced text."""
    both = _pair(spark, ref, hyp).select("ref", *(kana_functions.to_kana_udf(text.normalize_chars(F.col(c))).alias(f"{c}_said") for c in ("ref", "hyp")))
    return both.select(F.when(~text.is_space_delimited(F.col("ref")), text.plain_error_rate(F.col("ref_said"), F.col("hyp_said"))).alias("kana_cer"))


def coverage_kana(spark: SparkSession, ref: str, hyp: str, **options) -> DataFrame:
    got = align.supplementary(_pair(spark, ref, hyp), **options)
    return got.select("supplementary.coverage_kana", "supplementary.kana_excused", "supplementary.error")


def lenient(spark: SparkSession, ref: str, hyp: str, **options) -> DataFrame:
    return align.supplementary(_pair(spark, ref, hyp), **options).select("supplementary.*")


def timing_scores(spark: SparkSession, ref: str, hyp: str, min_anchor: int = 8, tol: float = 0.5, max_span: int = 40) -> DataFrame:
    """Drift and boundary agreement of two subtitle files; low_anchors: too little text agrees for the times to mean much."""
    cues = lambda path: transcripts.parse_cues(transcripts.texts(spark, path).withColumn("path", F.lit("pair"))).withColumnRenamed("path", "file_id")
    r, h = cues(ref), cues(hyp)
    drift = timing.drift_stats(r, h, "file_id", min_anchor, max_span).withColumn("low_anchors", F.col("anchor_coverage") < 0.5)
    return drift.join(timing.break_stats(r, h, "file_id", tol), "file_id").drop("file_id")


SCORERS = {"cer": cer, "coverage": coverage, "coverage_kana": coverage_kana, "kana": kana, "lenient": lenient, "timing": timing_scores}
