"""Text normalisation of whole texts.  Where SQL counts bytes it compares on their ASCII part."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.functions import kana
from skriva.functions import text as X
from skriva.operators.lineage import spread
from skriva.operators.readings import with_readings
from skriva.plans.cue_queries import _DROP
from skriva.plans.registered import query, read

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"
_DOCS = "with t as (select doc_id, nfc_normalize(text) as text from documents)"
_SPACED = "regexp_replace(regexp_replace(text, '[、。，．,.!?！？…・「」『』（）()\\[\\]〈〉《》：:;；\\-~〜?\"]+', ' ', 'g'), '\\s+', ' ', 'g')"


@query(_DOCS + f" select doc_id, md5({_DROP}) as digest from t")
def normalize_chars(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(X.normalize_chars(F.col("text"))).alias("digest"))


@query(_DOCS + f" select doc_id, md5(lower(trim({_SPACED}))) as digest from t")
def normalize_words(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(X.normalize_words(F.col("text"))).alias("digest"))


@query(_DOCS + f", w as (select doc_id, regexp_extract_all(lower(trim({_SPACED})), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?') as w from t) select doc_id, len(w)::bigint as n, md5(coalesce(list_aggregate(w, 'string_agg', ' '), '')) as digest from w")
def tokenize(spark, d):
    w = X.tokenize(F.col("text"))
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("select doc_id, case when length(text) > 0 and length(regexp_replace(substr(text, 1, 4000), '[^\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]', '', 'g'))/length(substr(text, 1, 4000)) < 0.15 then 'word' else 'char' end as unit from documents")
def script_unit(spark, d):
    return read(spark, d, "documents").select("doc_id", X.unit_of(F.col("text")).alias("unit"))


@query(
    """select conv_id, turn, (select coalesce(string_agg(x, chr(10) order by i), '') from (select trim(unnest(string_split(raw, chr(10)))) as x, generate_subscripts(string_split(raw, chr(10)), 1) as i)
    where x <> '' and not regexp_matches(x, '^\\d+$') and not regexp_matches(x, '^\\d{2}:\\d{2}:\\d{2},\\d{3} --> ')) as text
    from (select conv_id, turn, turn::varchar || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text || chr(10) || chr(10) || '17' as raw from conversations)"""
)
def srt_to_text(spark, d):
    raw = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), "text", F.lit("\n\n17"))
    return read(spark, d, "conversations").select("conv_id", "turn", X.subtitle_text(raw).alias("text"))


@query(
    """select conv_id, turn, (select coalesce(string_agg(x, chr(10) order by i), '') from (select unnest(string_split(raw, chr(10))) as x, generate_subscripts(string_split(raw, chr(10)), 1) as i)
    where not regexp_matches(x, '^\\s*$') and not regexp_matches(x, '^\\s*[A-Za-z][A-Za-z0-9_ .''-]{0,30}:\\s*$')) as text
    from (select conv_id, turn, role || ':' || chr(10) || text || chr(10) || ' ' || chr(10) || 'Dr. X:' as raw from conversations)"""
)
def strip_speakers(spark, d):
    raw = F.concat("role", F.lit(":\n"), "text", F.lit("\n \nDr. X:"))
    return read(spark, d, "conversations").select("conv_id", "turn", X.reference_text(F.lit("x.txt"), raw).alias("text"))


@query(f"with t as (select conv_id, turn, {_ASCII} as text from conversations) select a.conv_id, a.turn, round(levenshtein(a.text, b.text)/greatest(length(a.text), 1), 6) as cer from t a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1")
def plain_cer(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.plain_error_rate(F.col("text"), F.col("hyp")), 6).alias("cer"))


@query("select doc_id, (length(text) - length(replace(text, 'é', '')))::bigint as n from documents")
def replacement_count(spark, d):
    """Characters lost in decoding; as no text has any, each é is made one."""
    return read(spark, d, "documents").select("doc_id", X.replacement_chars(F.translate("text", "é", "\ufffd")).alias("n"))


@query("select lang, term, sum((length(lower(text)) - length(replace(lower(text), term, '')))//length(term))::bigint as hits from documents, (values ('the'), ('que'), ('und'), ('thth')) v(term) group by all")
def term_hits(spark, d):
    terms = spark.createDataFrame([("the",), ("que",), ("und",), ("thth",)], "term string")
    rows = read(spark, d, "documents").select("lang", F.lower("text").alias("text")).crossJoin(F.broadcast(terms))
    return rows.groupBy("lang", "term").agg(F.sum(X.occurrences(F.col("text"), F.col("term"))).alias("hits"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# How Japanese reads tens, hundreds and thousands, for the SQL side.
_SAID = ["いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
_PLACES = [
    ["", *_SAID], ["", "じゅう", *(x + "じゅう" for x in _SAID[1:])],
    ["", "ひゃく", "にひゃく", "さんびゃく", "よんひゃく", "ごひゃく", "ろっぴゃく", "ななひゃく", "はっぴゃく", "きゅうひゃく"],
    ["", "せん", "にせん", "さんぜん", "よんせん", "ごせん", "ろくせん", "ななせん", "はっせん", "きゅうせん"],
]


def _myriad(n: str) -> str:
    return " || ".join(f"{_list(_PLACES[k])}[({n})//{10**k}%10 + 1]" for k in (3, 2, 1, 0))


@query(f"select o_orderkey, case when o_orderkey = 0 then 'れい' when o_orderkey >= 10000 then {_myriad('o_orderkey//10000%10000')} || 'まん' else '' end || {_myriad('o_orderkey%10000')} as reading from orders")
def read_number(spark, d):
    n = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("digits"))
    return n.select("o_orderkey", kana.read_number_udf("digits").alias("reading"))


_WORD_COST = "('0x' || substr(md5(surface), 1, 4))::int % 300 + 50"
_STEP = "{{'c': {back}.c + {cost}, 'n': -{n}, 'r': {back}.r || {said}}}"


@query(
    f"""with recursive s as (select distinct substr(w, 1, k) as surface from (select unnest(regexp_extract_all(text, '[a-z]+')) as w from benchmark), (values (2), (3), (4)) v(k) where length(w) >= k),
    dict as (select surface, upper(surface) as said, {_WORD_COST} as cost from s),
    runs as (select distinct w from (select unnest(regexp_extract_all(text, '[a-z]+')) as w from documents)),
    p as (select w, 0 as k, {{'c': 0::bigint, 'n': 0, 'r': ''}} as b0, null::struct(c bigint, n int, r varchar) as b1, null::struct(c bigint, n int, r varchar) as b2, null::struct(c bigint, n int, r varchar) as b3 from runs
    union all select w, k + 1, list_sort(list_filter([{_STEP.format(back="b0", cost="150", n=1, said="substr(w, k + 1, 1)")}, {", ".join(_STEP.format(back=f"b{n - 1}", cost=f"d{n}.cost", n=n, said=f"d{n}.said") for n in (2, 3, 4))}], lambda x: x.c is not null))[1], b0, b1, b2
    from p {" ".join(f"left join dict d{n} on k + 1 >= {n} and d{n}.surface = substr(w, k + 2 - {n}, {n})" for n in (2, 3, 4))} where k < length(w)),
    read as (select w, b0.r as said from p where k = length(w)),
    t as (select doc_id, unnest(list_zip(x, range(len(x)))) as z from (select doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') as x from documents)),
    j as (select doc_id, string_agg(coalesce(said, z[1]), '' order by z[2]) as said from t left join read on read.w = z[1] group by doc_id)
    select doc_id, case when text is not null then md5(nfc_normalize(coalesce(said, ''))) end as digest from documents left join j using (doc_id)"""
)
def kana_reading(spark, d):
    """Whole texts read by a dictionary made of the beginnings of benchmark words, at costs that make words compete."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))
    starts = read(spark, d, "benchmark").select(word.alias("w")).select(F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("w"), F.lit(4))), lambda k: F.substr("w", F.lit(1), k))).alias("surface"), F.length("w").alias("n"))
    words = starts.where("n >= 2").select("surface").distinct().select("surface", F.upper("surface").alias("reading"), (F.conv(F.substring(F.md5("surface"), 1, 4), 16, 10).cast("int") % 300 + 50).alias("cost"))
    return with_readings(spread(read(spark, d, "documents").select("doc_id", "text")), "text", words, unknown=150).select("doc_id", F.md5("reading").alias("digest"))
