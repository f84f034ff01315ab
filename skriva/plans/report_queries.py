"""Sweeps, reports, registries and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.functions import text as X
from skriva.operators import registry as G
from skriva.operators import sweeps as S
from skriva.plans.registered import query, read
from skriva.sources import transcripts as R


@query(
    """with g as (select gap, chars from (values (0.6), (0.8), (1.2)) a(gap), (values (28), (48)) b(chars)),
    s as (select gap::double as gap, chars::double as chars, p_brand as file, count(*) filter (p_size > gap*10 and p_retailprice % 100 < chars) / count(*) as f1 from part, g group by all)
    select gap, chars, round(avg(f1), 6) as mean_f1, count(*) as files from s group by all order by mean_f1 desc, gap, chars limit 20"""
)
def cue_grid(spark, d):
    grid = S.grid(spark, gap="0.6,0.8,1.2", chars="28,48")
    hit = (F.col("p_size") > F.col("gap") * 10) & (F.col("p_retailprice") % 100 < F.col("chars"))
    per_file = S.cross(read(spark, d, "part"), grid).groupBy("gap", "chars", F.col("p_brand").alias("file")).agg((F.count_if(hit) / F.count("*")).alias("f1"))
    means = per_file.groupBy("gap", "chars").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.count("*").alias("files"))
    return S.top(means, 20, F.desc("mean_f1"), F.col("gap"), F.col("chars"))


@query(
    """select l_returnflag as label, round(avg(l_discount) filter (l_linenumber = 1), 6) as "1", round(avg(l_discount) filter (l_linenumber = 2), 6) as "2", round(avg(l_discount) filter (l_linenumber = 3), 6) as "3" from lineitem group by 1"""
)
def engine_pivot(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("dur")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return S.matrix(rows, "label", "dur", "v", [1, 2, 3])


@query("select p_type, arg_min(p_partkey, p_retailprice*100000 + p_partkey) as best, min(p_retailprice) as least from part group by 1")
def best_config(spark, d):
    return read(spark, d, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.col("p_retailprice") * 100000 + F.col("p_partkey")).alias("best"), F.min("p_retailprice").alias("least"))


@query("select p_brand, p_partkey, p_size, p_retailprice from part qualify row_number() over (partition by p_brand order by case when p_size <= 0.6*20 then 0 else 1 end, p_retailprice desc, p_partkey) = 1")
def safe_batch(spark, d):
    rows = read(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice", F.lit(20).alias("limit"))
    return G.fastest_safe(rows, "p_brand", "p_partkey", "p_retailprice", "p_size", "limit").drop("limit")


@query("select o_custkey, o_orderkey, round(o_totalprice - first_value(o_totalprice) over (partition by o_custkey order by o_orderkey), 4) as delta from orders")
def delta_first(spark, d):
    rows = S.delta_first(read(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice")
    return rows.select("o_custkey", "o_orderkey", F.round("delta", 4).alias("delta"))


@query("select p_brand, p_type, round(v - max(v) filter (p_type = 'ECONOMY') over (partition by p_brand), 4) as delta from (select p_brand, p_type, avg(p_retailprice) as v from part group by all)")
def delta_arm(spark, d):
    rows = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"))
    return S.delta_arm(rows, ["p_brand"], "p_type", "v", "ECONOMY").select("p_brand", "p_type", F.round("delta", 4).alias("delta"))


@query("select l_returnflag as unit, round(sum(l_discount*l_quantity)/sum(l_quantity), 6) as char, round(sum(l_tax*l_extendedprice)/sum(l_extendedprice), 6) as char_kana, round(sum(l_tax*l_linenumber)/sum(l_linenumber), 6) as char_lenient from lineitem group by 1")
def secondary_means(spark, d):
    from skriva.operators.stats import weighted_rate

    w = lambda e, n: F.round(weighted_rate(F.col(e), F.col(n)), 6)
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("unit")).agg(w("l_discount", "l_quantity").alias("char"), w("l_tax", "l_extendedprice").alias("char_kana"), w("l_tax", "l_linenumber").alias("char_lenient"))


@query("select sha256(text) as digest, count(*) as n, list_sort(list(doc_id)) as labels from documents group by 1 having count(*) > 1")
def dup_outputs(spark, d):
    return S.duplicate_outputs(read(spark, d, "documents"), "doc_id", "text")


@query("select lang, source, count(*) as runs, count(distinct text) = 1 as deterministic from documents group by all")
def determinism(spark, d):
    rows = read(spark, d, "documents").withColumn("key", F.struct("lang", "source"))
    return S.deterministic(rows, "key", "text").select("key.lang", "key.source", "runs", "deterministic")


@query("select l_returnflag as unit, round(min(l_discount - l_tax), 6) as least, round(max(l_discount - l_tax), 6) as most, round(avg(l_discount - l_tax), 6) as mean from lineitem group by 1")
def text_vs_srt_gap(spark, d):
    got = S.gaps(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "unit"), "unit", "l_discount", "l_tax")
    return got.select("unit", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")))


@query("select c_custkey, round(least(abs(c_acctbal), 5000), 2) as kept, abs(c_acctbal) > 5000 as truncated from customer")
def prompt_fit(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("n"))
    return rows.select("c_custkey", S.prompt_fit(F.col("n"), 5000).alias("p")).select("c_custkey", F.round("p.kept", 2).alias("kept"), "p.truncated")


@query(
    """with t as (select p_brand, list(p_name order by p_partkey) as t from part group by 1)
    select p_brand, unnest(['comma', 'ideographic', 'space', 'newline', 'semicolon', 'reversed', 'last3']) as variant,
    unnest([array_to_string(t, ', '), array_to_string(t, '、'), array_to_string(t, ' '), array_to_string(t, chr(10)), array_to_string(t, '; '), array_to_string(list_reverse(t), ', '), array_to_string(t[-3:], ', ')]) as prompt from t"""
)
def prompt_variants(spark, d):
    terms = read(spark, d, "part").select("p_brand", "p_name", "p_partkey")
    return S.prompts(terms, "p_brand", "p_name", "p_partkey")


# -- registries

_SNAP = "(case when {0} >= 128 then 128 when {0} >= 64 then 64 when {0} >= 32 then 32 when {0} >= 24 then 24 when {0} >= 16 then 16 when {0} >= 12 then 12 else 1 end)"


@query(f"select p_partkey, {_SNAP.format('p_partkey % 200')} as batch from part")
def snap_batch(spark, d):
    return read(spark, d, "part").select("p_partkey", G.snap_batch((F.col("p_partkey") % 200).cast("int")).alias("batch"))


_CHIPS = ["Apple M4", "Apple M4 Pro", "Apple M2 Ultra", "Apple M3 Pro", "Other"]
_MACHINE = """with m as (select s_suppkey, ['Apple M4', 'Apple M4 Pro', 'Apple M2 Ultra', 'Apple M3 Pro', 'Other'][s_suppkey % 5 + 1] as chip, (8 * (1 + s_suppkey % 20))::int as ram_gb, (s_suppkey % 70)::int as gpu_cores, s_acctbal/100 as gpu from supplier),
w as (select *, least(floor(greatest(gpu*0.5 - 2.5 - 0.6, 0)/(0.002*60))::int, 3*(case when gpu_cores = 0 then 16 else gpu_cores end)) as want from m),
p as (select *, case when contains(lower(chip), 'apple m4') and ram_gb = 16 or contains(lower(chip), 'apple m2 ultra') and ram_gb between 96 and 192 then 16 end as profile from w)"""


@query(_MACHINE + f" select s_suppkey, coalesce(profile, case when want < 12 then 1 else {_SNAP.format('want')} end)::int as batch, case when profile is null then 'derived' else 'profile' end as matched from p")
def resolve_profile(spark, d):
    chip = F.element_at(F.array(*map(F.lit, _CHIPS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "supplier").select("s_suppkey", chip.alias("chip"), (8 * (1 + F.col("s_suppkey") % 20)).cast("int").alias("ram_gb"), (F.col("s_suppkey") % 70).cast("int").alias("gpu_cores"), (F.col("s_acctbal") / 100).alias("gpu_working_set_gb"))
    return G.resolve_profile(rows, "s_suppkey").select("s_suppkey", "batch", "matched")


_ASK = [("whisper", None), ("whisper", "Large-V3"), ("voxtral", "big"), ("qwen3-asr", "0.6b"), ("kotoba", None), ("mlx-community/whisper-tiny-mlx", None), ("someone/distil-whisper-x", None), ("whisper-turbo", None), ("a/Qwen3_ASR-distil", None), (None, None)]
_WANT = [("mlx-whisper", None), ("mlx-whisper", None), (None, "unknown size big"), ("mlx-qwen3", None), ("mlx-chunked", None), ("mlx-whisper", None), ("mlx-chunked", None), (None, "unknown model whisper-turbo"), ("mlx-qwen3", None), ("voxtral", None)]
_LIT = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" for x in xs) + "]"


@query(f"select o_orderkey, {_LIT([b for b, _ in _WANT])}[o_orderkey % 10 + 1] as backend, {_LIT([e for _, e in _WANT])}[o_orderkey % 10 + 1] as error from orders")
def resolve_model(spark, d):
    at = (F.col("o_orderkey") % 10 + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(a[k]).cast("string") for a in _ASK)), at)
    rows = read(spark, d, "orders").select("o_orderkey", pick(0).alias("name"), pick(1).alias("size"))
    return G.resolve_model(rows).select("o_orderkey", "backend", "error")


@query("select p_partkey, case when contains(n, 'voxtral') then 'voxtral' when contains(n, 'qwen3-asr') then 'mlx-qwen3' when contains(n, 'kotoba') or contains(n, 'distil') then 'mlx-chunked' when contains(n, 'whisper') then 'mlx-whisper' else 'voxtral' end as backend from (select p_partkey, lower(p_name || ['Whisper', 'distil', 'Qwen3-ASR', 'kotoba-x', ''][p_partkey % 5 + 1]) as n from part)")
def infer_backend(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ["Whisper", "distil", "Qwen3-ASR", "kotoba-x", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", X.infer_backend(F.concat("p_name", tail)).alias("backend"))


_FORMS = ["ja", "ja_JP", "jpn", "JAPANESE", "en-US", "xx", "English", "yue", "klingon", "deu"]
_ISO = ["ja", "ja", "ja", "ja", "en", None, "en", "yue", None, "de"]
_NAMES = ["Japanese", "Japanese", "Japanese", "Japanese", "English", None, "English", "Cantonese", None, "German"]


@query(f"select o_orderkey, {_LIT(_ISO)}[o_orderkey % 10 + 1] as iso, {_LIT(_NAMES)}[o_orderkey % 10 + 1] as name from orders")
def language_norm(spark, d):
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", G.to_iso(form).alias("iso"), G.to_english_name(form).alias("name"))


@query("select event_id, list_filter([case when value/100 > 0.35 then 'load' end, case when value > 3.0 then 'gpu memory' end, case when value > 200 then 'swapping' end, case when event_id % 3 = 0 then 'battery' end, case when event_id % 7 = 0 then 'low power mode' end], lambda r: r is not null) as reasons from events")
def busy_reasons(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", X.busy_reasons(v, F.lit(100.0), v, v, F.col("event_id") % 3 == 0, F.col("event_id") % 7 == 0).alias("reasons"))


@query(
    """with s as (select c_custkey, c_custkey % 4 as k, 'rec' || c_custkey as stem from customer)
    select stem, stem || '.wav' as audio, case k when 0 then stem || '_transcript.txt' when 1 then stem || '.srt' else stem || '.txt' end as reference from s where k < 3"""
)
def pair_files(spark, d):
    stem, k = F.concat(F.lit("rec"), F.col("c_custkey").cast("string")), F.col("c_custkey") % 4
    suffixes = F.array(F.lit(".wav"), F.when(k == 0, "_transcript.txt"), F.when(k <= 1, ".srt"), F.when(k <= 2, ".txt"), F.when(k == 3, ".vtt"))
    names = read(spark, d, "customer").select(F.explode(F.transform(F.filter(suffixes, lambda s: s.isNotNull()), lambda s: F.concat(stem, s))).alias("name"))
    return R.pair_files(names)


@query("select s_suppkey, case when s_suppkey % 6 = 0 then 'unknown' else 'M' || (s_suppkey % 6)::varchar end as family, printf('%.2f%%', s_acctbal/10000*100) as share from supplier")
def labels_and_formats(spark, d):
    k = F.col("s_suppkey") % 6
    chip = F.when(k == 0, "Other").otherwise(F.concat(F.lit("Apple m"), k.cast("string"), F.lit(" Max")))
    return read(spark, d, "supplier").select("s_suppkey", X.chip_family(chip).alias("family"), X.percent(F.col("s_acctbal") / 10000).alias("share"))
