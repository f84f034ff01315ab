"""Alignment scores: a conversation's turn is the reference of the turn that follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.functions import text as X
from skriva.operators import align as A
from skriva.operators.lineage import spread
from skriva.plans.cue_queries import _DROP
from skriva.plans.registered import query, read


def _pairs(spark, d):
    t = spread(read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("ref")))
    return t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp")), ["conv_id", "turn"])


_COLUMNS = ("conv_id", "turn", "unit", "ref_units", "hyp_units", "coverage", "error_rate", "coverage_error", "subs", "dels", "insertions_counted", "insertions_excused")


_COPIES = f"""with t as (select conv_id, turn, {_DROP} as s from conversations), p as (select *, length(s) as n, (turn*7 + 5 + conv_id) % 60 as more, least(length(s), (turn*3 + conv_id) % 20) as less from t)"""


@query(
    _COPIES
    + """ select conv_id, turn, 'char' as unit, n as ref_units, case when turn % 2 = 0 then n + more else n - less end as hyp_units, round(case when turn % 2 = 0 then n else n - less end / greatest(n, 1), 6) as coverage,
    round(case when turn % 2 = 0 then more else less end / greatest(n, 1), 6) as error_rate, round(case when turn % 2 = 1 then less when more < 30 then more else 0 end / greatest(n, 1), 6) as coverage_error,
    0::bigint as subs, case when turn % 2 = 0 then 0 else less end::bigint as dels, case when turn % 2 = 0 and more < 30 then more else 0 end::bigint as insertions_counted, case when turn % 2 = 0 and more >= 30 then more else 0 end::bigint as insertions_excused from p"""
)
def coverage_score(spark, d):
    """Copies of a text with foreign characters put into the middle, or without the end: whatever the path, the counts are the same."""
    t = read(spark, d, "conversations").select("conv_id", "turn", X.normalize_chars(F.col("text")).alias("ref"))
    n, more = F.length("ref"), ((F.col("turn") * 7 + 5 + F.col("conv_id")) % 60).cast("int")
    half = F.floor(n / 2).cast("int")
    less = F.least(n, ((F.col("turn") * 3 + F.col("conv_id")) % 20).cast("int"))
    longer = F.concat(F.substr("ref", F.lit(1), half), F.repeat(F.lit("龍"), more), F.substr("ref", half + 1))
    got = A.score_pairs(t.withColumn("hyp", F.when(F.col("turn") % 2 == 0, longer).otherwise(F.substr("ref", F.lit(1), n - less))), unit="char")
    return got.select(*(F.round(c, 6).alias(c) if c in ("coverage", "error_rate", "coverage_error") else c for c in _COLUMNS))


@query()
def score_pair(spark, d):
    return A.score_pairs(_pairs(spark, d)).select(*_COLUMNS)


@query(
    """with p as (select conv_id, turn, 2*(turn % 5 + 1) as n, conv_id % 2 as wrong from conversations)
    select conv_id, turn, n*wrong as lenient_errors, n*(1 - wrong) as forgiven, round(n*wrong/(n + 2), 6) as lenient_cer, round(n*wrong/2/(n + 2), 6) as coverage_kana, 0::bigint as kana_excused, round(n*wrong/(n + 2), 6) as coverage_lenient, n as charged_edits from p"""
)
def lenient_scores(spark, d):
    """Katakana against hiragana of the same or of another reading."""
    k = (F.col("turn") % 5 + 1).cast("int")
    said = F.when(F.col("conv_id") % 2 == 0, "かた").otherwise("かさ")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.repeat(F.lit("カタ"), k), F.lit("です")).alias("ref"), F.concat(F.repeat(said, k), F.lit("です。")).alias("hyp"))
    got = A.supplementary(rows).select("conv_id", "turn", "supplementary.*").drop("variants", "error")
    return got.select(*(F.round(c, 6).alias(c) if c in ("lenient_cer", "coverage_kana", "coverage_lenient") else c for c in got.columns))


@query(
    """with p as (select 2*(turn % 5 + 1) as n, turn % 5 + 1 as k from conversations where conv_id % 2 = 0)
    select repeat('カタ', k::int) as ref, repeat('かた', k::int) as hyp, sum(n)::bigint as edits, count(*) as times from p group by k order by edits desc, ref limit 3"""
)
def forgiven_top(spark, d):
    k = (F.col("turn") % 5 + 1).cast("int")
    rows = read(spark, d, "conversations").where("conv_id % 2 = 0").select(F.concat(F.repeat(F.lit("カタ"), k), F.lit("です")).alias("ref"), F.concat(F.repeat(F.lit("かた"), k), F.lit("です")).alias("hyp"))
    return A.top_forgiven(A.supplementary(rows), 3)


@query()
def region_cer(spark, d):
    scored = A.score_pairs(_pairs(spark, d).withColumn("key", F.concat_ws(":", "conv_id", "turn")), unit="word")
    return A.region_errors(scored, "key", 10)
