"""Queries over what runs decide: skips, refusals, order, context, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.operators import align as A
from skriva.operators import runs as R
from skriva.operators import sweeps
from skriva.plans.registered import query, read


def _files(spark, d):
    """Every third text is written without spaces."""
    kana = F.repeat(F.lit("ひらがなとカタカナ"), 20)
    return read(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, kana).otherwise(F.col("text")).alias("ref"))


@query("select doc_id, doc_id % 3 <> 0 and length(text) > 0 as skipped, case when doc_id % 3 <> 0 and length(text) > 0 then 'reference is space-delimited' end as reason from documents")
def language_skips(spark, d):
    return R.language_skips(_files(spark, d)).select("doc_id", "skipped", "reason")


@query("select source, list_sort(list(distinct case when doc_id % 3 = 0 then 'char' else 'word' end)) as units, count(distinct doc_id % 3 = 0) > 1 and max(source) <> 'src1' as refused from documents group by source")
def mixed_scripts(spark, d):
    return R.mixed_scripts(_files(spark, d), "source", forced=F.col("source") != "src1")


@query("select label, metric, row_number() over (order by metric nulls last, label) as place from (select p_brand as label, case when right(p_brand, 1) <> '3' then round(avg(p_retailprice), 4) end as metric from part group by 1)")
def engine_summary(spark, d):
    rows = read(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.round(F.avg("p_retailprice"), 4).alias("m"))
    return R.ranked(rows.select("label", F.when(F.substr("label", F.length("label")) != "3", F.col("m")).alias("metric")), "label", "metric")


@query("select conv_id, turn, right(lag(text) over (partition by conv_id order by turn), 200) as context from conversations")
def context_carry(spark, d):
    return R.previous_text(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "context")


@query("select event_type, count(*) filter (value > 90) as count, list_sort(list(event_id) filter (value > 90))[1:10] as first from events group by event_type")
def flagged_files(spark, d):
    return R.flagged(read(spark, d, "events"), "event_type", F.col("value") > 90, "event_id")


@query(
    """with p as (select conv_id, turn, 2*(turn % 5 + 1) as n, conv_id % 2 as wrong from conversations)
    select conv_id, turn, 4::bigint as regions, n + 2 as ref_len, round(n*wrong, 6)::double as edits from p"""
)
def lenient_regions(spark, d):
    """Errors of katakana against hiragana, laid out over four regions and added up again."""
    k = (F.col("turn") % 5 + 1).cast("int")
    said = F.when(F.col("conv_id") % 2 == 0, "かた").otherwise("かさ")
    pairs = read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key"), F.concat(F.repeat(F.lit("カタ"), k), F.lit("です")).alias("ref"), F.concat(F.repeat(said, k), F.lit("です")).alias("hyp"))
    scored = A.supplementary(A.score_pairs(pairs, unit="char")).withColumn("lenient_errors", F.col("supplementary.lenient_errors"))
    got = R.lenient_regions(scored, "key", regions=4).groupBy("key").agg(F.count("*").alias("regions"), F.sum("ref_len").alias("ref_len"), F.round(F.sum("edits"), 6).alias("edits"))
    return got.join(pairs.select("conv_id", "turn", "key"), "key").select("conv_id", "turn", "regions", "ref_len", "edits")


@query(
    """with t as (select p_brand, list(p_name order by p_partkey)[1:p_n] as t, case when right(p_brand, 1) = '1' then '' else 'about ' || p_brand end as topic from (select *, case when right(p_brand, 1) = '2' then 0 else 3 end as p_n from part) group by p_brand, p_n)
    select p_brand, variant, prompt from (select p_brand, unnest(['none', 'terms', 'topic', 'topic_terms', 'hint_terms']) as variant, unnest(['', array_to_string(t, ', '), topic, topic || ' ' || array_to_string(t, ', '), 'in English: ' || array_to_string(t, ', ')]) as prompt, len(t) as n, topic from t)
    where variant = 'none' or variant = 'topic' and topic <> '' or variant in ('terms', 'hint_terms') and n > 0 or variant = 'topic_terms' and n > 0 and topic <> ''"""
)
def prompt_contents(spark, d):
    lists = read(spark, d, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("t"))
    end = F.substr("p_brand", F.length("p_brand"))
    lists = lists.select("p_brand", F.slice("t", F.lit(1), F.when(end == "2", 0).otherwise(3)).alias("t"), F.when(end == "1", "").otherwise(F.concat(F.lit("about "), "p_brand")).alias("topic"))
    return sweeps.prompt_contents(lists, "p_brand", F.col("t"), F.col("topic"), F.lit("in English:"))
