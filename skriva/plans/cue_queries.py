"""Cues: a conversation is a cue list (a turn's start = characters before it / 15); events are timed tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skriva.functions import text as X
from skriva.operators import cues as C
from skriva.operators import timing as T
from skriva.plans.registered import query, read
from skriva.sources import transcripts as R

#: Cues of every conversation, with one-line texts.
_CUES = """with c as (select conv_id as file_id, turn as cue_idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, length(text) as n from conversations),
cues as (select file_id, cue_idx, text, coalesce(sum(n) over (partition by file_id order by cue_idx rows between unbounded preceding and 1 preceding), 0)/15.0::double as start_s,
 sum(n) over (partition by file_id order by cue_idx)/15.0::double as end_s from c)"""


def _cues(spark, d):
    line = Window.partitionBy("file_id").orderBy("cue_idx")
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("cue_idx"), "text", F.length("text").alias("n"))
    rows = rows.withColumn("start_s", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(15.0)).withColumn("end_s", F.sum("n").over(line) / F.lit(15.0))
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select("file_id", "cue_idx", said.alias("text"), "start_s", "end_s")


def _ts(x: str, sep: str) -> str:
    ms = f"round_even(({x})*1000, 0)::bigint"
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms}//3600000, {ms}//60000%60, {ms}//1000%60, {ms}%1000)"


_WRAP = "list_aggregate(list_transform(range(ceil(length(text)/16.0)::bigint), lambda i: substr(text, (i*16+1)::bigint, 16)), 'string_agg', chr(10))"


def _document(sep: str, head: str = "''") -> str:
    end = "greatest(end_s, start_s + 0.5)"
    return _CUES + f""" select file_id, md5({head} || string_agg((cue_idx+1)::varchar || chr(10) || {_ts('start_s', sep)} || ' --> ' || {_ts(end, sep)} || chr(10) || coalesce({_WRAP}, '') || chr(10) || chr(10), '' order by cue_idx)) as digest from cues group by file_id"""


@query(_document(","))
def srt_format(spark, d):
    return C.srt(_cues(spark, d)).select("file_id", F.md5("document").alias("digest"))


@query(_document(".", "'WEBVTT' || chr(10) || chr(10)"))
def vtt_format(spark, d):
    return C.vtt(_cues(spark, d)).select("file_id", F.md5("document").alias("digest"))


@query(_CUES + " select file_id, md5(string_agg(text, chr(10) order by cue_idx) || chr(10)) as digest from cues group by file_id")
def txt_format(spark, d):
    return C.txt(_cues(spark, d)).select("file_id", F.md5("document").alias("digest"))


@query(_CUES + " select file_id, md5(string_agg(text, '' order by cue_idx)) as said, count(*) as segments, round(sum(round_even(start_s*1000, 0)/1000), 2) as starts, round(max(round_even(end_s*1000, 0)/1000), 3) as ends, md5(string_agg(text, '|' order by cue_idx)) as texts from cues group by file_id")
def cue_json(spark, d):
    """The JSON documents, read again."""
    shape = "struct<text:string,segments:array<struct<id:int,start:double,end:double,text:string>>>"
    j = C.json_document(_cues(spark, d)).select("file_id", F.from_json("document", shape).alias("j"))
    total = F.aggregate("j.segments", F.lit(0.0), lambda a, s: a + s["start"])
    return j.select("file_id", F.md5("j.text").alias("said"), F.size("j.segments").cast("bigint").alias("segments"), F.round(total, 2).alias("starts"), F.round(F.array_max("j.segments.end"), 3).alias("ends"), F.md5(F.array_join("j.segments.text", "|")).alias("texts"))


@query(_CUES + f" select file_id, cue_idx, coalesce({_WRAP}, '') as wrapped from cues")
def wrap_text(spark, d):
    return _cues(spark, d).select("file_id", "cue_idx", X.wrap(F.col("text")).alias("wrapped"))


@query(_CUES + " select file_id, (row_number() over (partition by file_id order by cue_idx) - 1)::int as cue_idx, round(round_even(start_s*1000, 0)/1000, 3) as start_s, round(round_even(greatest(end_s, start_s + 0.5)*1000, 0)/1000, 3) as end_s, length(text) as n_chars from cues")
def parse_cues(spark, d):
    """Round trip: cues written as SRT and read again (text lengths before wrapping)."""
    back = R.parse_cues(C.srt(_cues(spark, d), width=1 << 20).withColumnRenamed("document", "raw"), "file_id")
    return back.select("file_id", "cue_idx", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.length("text").cast("bigint").alias("n_chars"))


@query("select user_id, event_id, cue_idx from (select user_id, event_id, sum(case when epoch_us(ts)/1e6 - epoch_us(prev)/1e6 > 14400 then 1 else 0 end) over (partition by user_id order by ts)::bigint as cue_idx from (select *, lag(ts) over (partition by user_id order by ts) as prev from events))")
def cue_sessions(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t_s"))
    return C.sessions(rows, "user_id", "t_s", 14400.0).select("user_id", "event_id", "cue_idx")


@query()
def cue_build(spark, d):
    """Event types as tokens: a token every 0.08 s, a pause where the next event of the user is a day away."""
    line = Window.partitionBy("user_id").orderBy("event_id")
    day = F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(86400.0)
    rows = read(spark, d, "events").select(F.col("user_id").alias("file_id"), F.lit(0).alias("chunk_idx"), F.col("event_id").alias("pos"), F.encode("event_type", "UTF-8").alias("bytes"), (F.row_number().over(line) * F.lit(0.08) + day).alias("t_s"))
    return C.build(rows)


@query(_CUES + " select file_id, cue_idx, end_s > start_s and length(text)/(end_s - start_s) > 12 as runaway from cues")
def runaway(spark, d):
    rows = _cues(spark, d)
    return rows.select("file_id", "cue_idx", X.runaway(F.col("text"), F.col("end_s") - F.col("start_s"), 12.0).alias("runaway"))


@query(
    _CUES
    + """ select file_id, count(*) as windows, count(*) filter (text = '') as empty, count(*) filter (end_s > start_s and length(text)/(end_s - start_s) > 25) as runaways,
    max(end_s*0.995)/sum(end_s - start_s) < 0.99 as truncated from cues group by file_id"""
)
def decode_health(spark, d):
    from skriva.operators import seam

    rows = _cues(spark, d).withColumn("dur", F.col("end_s") - F.col("start_s")).withColumn("last", F.col("end_s") * 0.995)
    return seam.health(rows, "file_id", "text", "dur", "last")


@query(_CUES + " select file_id, cue_idx, round(greatest(end_s - 3, start_s + 0.05), 6) as end_s from cues")
def end_clamp(spark, d):
    return _cues(spark, d).select("file_id", "cue_idx", F.round(C.end_clamp(F.col("start_s"), F.col("end_s") - 3), 6).alias("end_s"))


@query("select conv_id, turn, length(text) = strlen(text) or (ascii(substr(text, 8, 1)) < 128) as complete from (select conv_id, turn, text from conversations)")
def utf8_complete(spark, d):
    rows = read(spark, d, "conversations")
    # the bytes up to the middle of the eighth character are complete only if it is one byte long
    head = F.substring("text", 1, 7)
    cut = F.expr("substring(encode(text, 'UTF-8'), 1, octet_length(substring(text, 1, 7)) + 1)")
    return rows.select("conv_id", "turn", ((F.length("text") == F.octet_length("text")) | X.utf8_complete(cut)).alias("complete"), head.alias("h")).drop("h")


# -- timing: the same cue lists, the hypothesis shifted by 0.3 s every other cue

_BOTH = _CUES + ", h as (select file_id, cue_idx, text, start_s + 0.3*(cue_idx % 2) as start_s, end_s + 0.3*(cue_idx % 3) as end_s from cues)"


def _hyp(spark, d):
    return _cues(spark, d).withColumn("start_s", F.col("start_s") + 0.3 * (F.col("cue_idx") % 2)).withColumn("end_s", F.col("end_s") + 0.3 * (F.col("cue_idx") % 3))


_DROP = "regexp_replace(text, '[\\s、。，．,.!?！？…・「」『』（）()\\[\\]〈〉《》：:;；\\-~〜?]+', '', 'g')"


@query(_CUES + f", n as (select *, {_DROP} as s from cues), e as (select *, unnest(range(length(s))) as i from n) select file_id, (row_number() over (partition by file_id order by cue_idx, i) - 1)::int as char_pos, s[i+1] as ch, round(start_s + greatest(end_s - start_s, 1e-6)*(i + 0.5)/length(s), 6) as t_s from e")
def char_timeline(spark, d):
    return T.timeline(_cues(spark, d), normal=False).select("file_id", "char_pos", "ch", F.round("t_s", 6).alias("t_s"))


@query(
    _BOTH
    + """ , e as (select file_id, (h.start_s - cues.start_s)*1000 as error_ms, cues.start_s/60 as at_min from h join cues using (file_id, cue_idx)),
    p as (select file_id, list_sort(list(abs(error_ms))) as l from e group by 1)
    select e.file_id, count(*) as anchors, round(median(abs(error_ms)), 4) as median_abs_ms, round(any_value(l[round_even(0.95*(len(l) - 1), 0)::bigint + 1]), 4) as p95_abs_ms, round(max(abs(error_ms)), 4) as max_abs_ms,
    round(median(error_ms), 4) as constant_offset_ms, round(case when regr_count(error_ms, at_min) >= 3 and regr_sxx(error_ms, at_min) >= 1e-9 then regr_slope(error_ms, at_min) end, 4) as slope, round(max(at_min) - min(at_min), 4) as span_min
    from e join p using (file_id) group by e.file_id"""
)
def drift_stats(spark, d):
    """Drift over cue starts (one anchor a cue); alignment-based anchors are tested on fixtures."""
    both = _hyp(spark, d).select("file_id", "cue_idx", F.col("start_s").alias("h")).join(_cues(spark, d), ["file_id", "cue_idx"])
    e = both.select("file_id", ((F.col("h") - F.col("start_s")) * 1000).alias("error_ms"), (F.col("start_s") / 60).alias("at_min"))
    got = T.drift(e, "file_id").withColumnRenamed("drift_slope_ms_per_min", "slope")
    return got.select("file_id", "anchors", *(F.round(c, 4).alias(c) for c in ("median_abs_ms", "p95_abs_ms", "max_abs_ms", "constant_offset_ms", "slope", "span_min")))


@query()
def anchor_drift(spark, d):
    return T.drift_stats(_cues(spark, d), _hyp(spark, d))


@query(_BOTH + " select file_id, round(h.end_s, 6) as h, round(cues.end_s, 6) as r from h join cues using (file_id) where abs(h.end_s - cues.end_s) <= 0.5")
def break_candidates(spark, d):
    from skriva.operators.joins import band

    ends = lambda c, n: c.select("file_id", F.col("end_s").alias(n))
    got = band(ends(_hyp(spark, d), "h"), ends(_cues(spark, d), "r"), "h", "r", 0.5, ["file_id"])
    return got.select("file_id", F.round("h", 6).alias("h"), F.round("r", 6).alias("r"))


@query(
    _BOTH.replace("with c as", "with recursive c as", 1)
    + """ , p as (select distinct file_id, h.end_s as h, cues.end_s as r from h join cues using (file_id) where abs(h.end_s - cues.end_s) <= 0.5),
    g as (select distinct file_id, 0 as n, []::double[] as hs, []::double[] as rs from cues
     union all select file_id, n + 1, list_append(hs, b.h), list_append(rs, b.r) from (select g.file_id, g.n, g.hs, g.rs, min_by({'h': p.h, 'r': p.r}, {'gap': abs(p.h - p.r), 'h': p.h, 'r': p.r}) as b
     from g join p on p.file_id = g.file_id where not list_contains(g.hs, p.h) and not list_contains(g.rs, p.r) group by all)),
    tp as (select file_id, max(n) as tp from g group by 1),
    mid as (select x.file_id, count(*) as mid from h x asof join cues c on x.file_id = c.file_id and x.end_s >= c.start_s where c.start_s + 0.5 < x.end_s and x.end_s < c.end_s - 0.5 group by 1),
    s as (select file_id, count(*) as n, median(end_s - start_s) as dur from cues group by 1), t as (select file_id, count(*) as n, median(end_s - start_s) as dur from h group by 1)
    select file_id, s.n as ref_cues, t.n as hyp_cues, tp::bigint as tp, round(tp/t.n, 6) as boundary_precision, round(tp/s.n, 6) as boundary_recall, round(case when tp > 0 then 2*(tp/t.n)*(tp/s.n)/(tp/t.n + tp/s.n) else 0 end, 6) as break_f1,
    round(coalesce(mid, 0)/t.n, 6) as mid_phrase_rate, round(s.dur, 6) as ref_median_dur_s, round(t.dur, 6) as hyp_median_dur_s from s join t using (file_id) join tp using (file_id) left join mid using (file_id)"""
)
def break_f1(spark, d):
    got = T.break_stats(_cues(spark, d), _hyp(spark, d))
    counts = ("file_id", "ref_cues", "hyp_cues", "tp")
    return got.select(*counts, *(F.round(c, 6).alias(c) for c in got.columns if c not in counts))


@query(_BOTH + " select h.file_id, round(h.end_s, 6) as h, round(c.start_s, 6) as start_s from h asof join cues c on h.file_id = c.file_id and h.end_s >= c.start_s where c.start_s + 0.25 < h.end_s and h.end_s < c.end_s - 0.25")
def mid_phrase(spark, d):
    got = T.mid_phrase(_cues(spark, d), _hyp(spark, d).select("file_id", F.col("end_s").alias("h")), "file_id", "h", 0.25)
    return got.select("file_id", F.round("h", 6).alias("h"), F.round("start_s", 6).alias("start_s"))


@query(
    """with e as (select event_type as key, list_sort(list(value)) as l, avg(value) as mean, max(abs(coalesce(value - 50, 0))) as steepest from events group by 1)
    select key, l[len(l)//2 + 1] as upper_median, round(mean, 6) as mean, round(steepest, 6) as steepest from e"""
)
def timing_summary(spark, d):
    rows = read(spark, d, "events").groupBy(F.col("event_type").alias("key"))
    return rows.agg(T.upper_median(F.collect_list("value")).alias("upper_median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max(F.abs(F.coalesce(F.col("value") - 50, F.lit(0.0)))), 6).alias("steepest"))


@query(
    _CUES
    + """, l as (select file_id, greatest(ceil(max(start_s)/30), 1)*30 as last from cues group by 1),
    z as (select case when least(floor(start_s/30)*30, last) >= 30 and start_s - least(floor(start_s/30)*30, last) < 3 then 'after' when greatest(ceil(start_s/30)*30, 30) <= last and greatest(ceil(start_s/30)*30, 30) - start_s < 3 then 'before' else 'elsewhere' end as zone
    from cues join l using (file_id)) select zone, count(*) as edits, round(count(*)/sum(count(*)) over (), 6) as share from z group by zone"""
)
def seam_enrichment(spark, d):
    """Shares of cue starts after, before and away from seams at every 30 s."""
    cues = _cues(spark, d).withColumn("t_s", F.col("start_s"))
    last = cues.groupBy("file_id").agg(F.max("t_s").alias("m"))
    seams = last.select("file_id", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("m") / 30), F.lit(1)).cast("int"))).alias("k")).select("file_id", (F.col("k") * 30.0).alias("seam_s"))
    zoned = T.seam_zones(cues, seams, "file_id")
    return zoned.groupBy("zone").agg(F.count("*").alias("edits")).withColumn("share", F.round(F.col("edits") / F.sum("edits").over(Window.partitionBy(F.lit(1))), 6))
