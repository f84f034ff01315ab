"""Levels and chunking: embeddings are frames of samples, events a line of frame levels by event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.functions import signal as G
from skriva.operators import chunking as C
from skriva.operators import scan
from skriva.plans.registered import query, read
from skriva.sources import audio

_PEAK = "20*log10(greatest(list_max(list_transform(embedding, lambda x: abs(x::double))), 1e-12))"


def _e(spark, d):
    return read(spark, d, "embeddings")


@query(f"select vec_id, round({_PEAK}, 6) as peak_dbfs from embeddings")
def peak_dbfs(spark, d):
    return _e(spark, d).select("vec_id", F.round(G.peak_dbfs(F.col("embedding")), 6).alias("peak_dbfs"))


@query(
    """select vec_id, i::int as frame_idx, round(20*log10(greatest(sqrt(list_sum(list_transform(embedding[i*16+1:i*16+16], lambda x: x::double*x::double))/16), 1e-10)), 6) as db
    from (select vec_id, embedding, unnest(range(len(embedding)//16)) as i from embeddings)"""
)
def frame_db(spark, d):
    return _e(spark, d).select("vec_id", F.posexplode(G.frame_db(F.col("embedding"), 16)).alias("frame_idx", "db")).withColumn("db", F.round("db", 6))


@query(f"select vec_id, round(case when {_PEAK} < -6 then -1 - {_PEAK} else 0 end, 6) as gain_db from embeddings")
def auto_gain(spark, d):
    return _e(spark, d).select("vec_id", F.round(G.auto_gain_db(F.col("embedding")), 6).alias("gain_db"))


@query(f"select vec_id, round(case when {_PEAK} > -50 and {_PEAK} < -1 then least(-1 - {_PEAK}, 20) else 0 end, 6) as gain_db from embeddings")
def chunk_gain(spark, d):
    return _e(spark, d).select("vec_id", F.round(G.chunk_gain_db(F.col("embedding")), 6).alias("gain_db"))


_RMS = """with f as (select vec_id, embedding, list_transform(range(len(embedding)//16), lambda i: embedding[i*16+1:i*16+16]) as fs from embeddings),
l as (select vec_id, embedding, fs, list_transform(fs, lambda f: 20*log10(greatest(sqrt(list_sum(list_transform(f, lambda x: x::double*x::double))/16), 1e-10))) as db from f),
t as (select l.*, (select quantile_cont(v, 0.6) from (select unnest(db) as v)) as p60 from l),
a as (select vec_id, embedding, flatten(list_filter(fs, lambda f: 20*log10(greatest(sqrt(list_sum(list_transform(f, lambda x: x::double*x::double))/16), 1e-10)) > p60)) as loud from t),
g as (select vec_id, embedding, sqrt(list_sum(list_transform(loud, lambda x: x::double*x::double))/len(loud)) as rms from a)"""


@query(_RMS + " select vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(-1, least(1, x::double*pow(10, -23/20.0::double)/rms)))), 5) as total from g")
def apply_gain(spark, d):
    y = G.apply_gain(F.col("embedding"), "rms", frame=16)
    return _e(spark, d).select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("select vec_id, round(len(list_filter(embedding, lambda x: abs(x::double) >= 0.2))/64.0, 6)::double as share from embeddings")
def clip_share(spark, d):
    return _e(spark, d).select("vec_id", F.round(G.clipped_share(F.col("embedding"), 0.2), 6).alias("share"))


@query("select a.vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double))), 6) as gap from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def agreement(spark, d):
    a, b = _e(spark, d), _e(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(G.largest_gap(F.col("embedding"), F.col("other")), 6).alias("gap"))


BELOW, MIN_RUN, KEEP = -110.0, 5, 3
_FRAMES = f"""with q as (select event_type as file, event_id, value < quantile_cont(value, 0.95) over (partition by event_type) + {BELOW} as quiet from events),
e as (select *, case when quiet = lag(quiet) over w then 0 else 1 end as edge from q window w as (partition by file order by event_id)),
r as (select *, sum(edge) over (partition by file order by event_id) as run from e),
n as (select *, count(*) over (partition by file, run) as run_len, row_number() over (partition by file, run order by event_id) as in_run from r),
k as (select *, not (quiet and run_len >= {MIN_RUN} and in_run > {KEEP}) as keep from n)"""


def _frames(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("file"), "event_id", "value")
    return C.silence_frames(rows, "file", "event_id", "value", BELOW, MIN_RUN, KEEP)


@query(_FRAMES + " select file, count(*) as frames, count(*) filter (quiet) as quiet, count(*) filter (keep) as kept, count(distinct run) as runs, max(run_len) filter (quiet) as longest from k group by file")
def silence_runs(spark, d):
    return _frames(spark, d).groupBy("file").agg(F.count("*").alias("frames"), F.count_if("quiet").alias("quiet"), F.count_if("keep").alias("kept"), F.count_distinct("run").alias("runs"), F.max(F.when(F.col("quiet"), F.col("run_len"))).alias("longest"))


_MAP = _FRAMES + """, o as (select *, row_number() over w - 1 as old, sum(keep::int) over w - 1 as new, coalesce(lag(keep) over w, false) as before from k window w as (partition by file order by event_id)),
m as (select file, new*0.08 as new_start_s, old*0.08 as old_start_s from o where keep and not before)"""


@query(_MAP + " select file, round(new_start_s::double, 6) as new_start_s, round(old_start_s::double, 6) as old_start_s from m")
def time_map(spark, d):
    return C.time_map(_frames(spark, d), "file", "event_id").select("file", F.round("new_start_s", 6).alias("new_start_s"), F.round("old_start_s", 6).alias("old_start_s"))


@query(_MAP + ", t as (select event_type as file, event_id, event_id/100.0 + 0.013 as t_s from events) select t.file, event_id, round((old_start_s + (t_s - new_start_s))::double, 6) as old_s from t asof join m on t.file = m.file and t.t_s >= m.new_start_s")
def map_time(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("file"), "event_id", (F.col("event_id") / F.lit(100.0) + F.lit(0.013)).alias("t_s"))
    return C.map_time(rows, C.time_map(_frames(spark, d), "file", "event_id"), "file", "t_s").select("file", "event_id", F.round("old_s", 6).alias("old_s"))


@query(_FRAMES + ", s as (select file, run, min(event_id) as first_frame, count(*) as run_len from k where quiet group by all) select file, first_frame, run_len, first_frame + run_len//2 as middle from s qualify row_number() over (partition by file order by run_len desc, first_frame) = 1")
def longest_quiet_run(spark, d):
    return C.longest_quiet_run(_frames(spark, d), "file", "event_id")


@query(
    """select file, event_id + 4 as at, round(e, 6) as energy from (select event_type as file, event_id, avg(value*value) over w as e, count(*) over w as n from events window w as (partition by event_type order by event_id rows between current row and 7 following))
    where n = 8 qualify row_number() over (partition by file order by e, event_id) = 1"""
)
def energy_min(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("file"), "event_id", "value")
    return C.quietest_window(rows, "file", "event_id", "value", 8).select("file", "at", F.round("energy", 6).alias("energy"))


_OFFSETS = """with c as (select o_custkey as file, o_orderkey as idx, floor(o_totalprice)::bigint as n from orders),
o as (select *, coalesce(sum(n) over (partition by file order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start_sample from c)"""


def _chunks(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("bigint").alias("n"))
    return C.chunk_offsets(rows, "file", "idx", "n")


@query(_OFFSETS + " select file, idx, start_sample, round(start_sample/16000.0, 6)::double as offset_s from o")
def chunk_offsets(spark, d):
    return _chunks(spark, d).select("file", "idx", "start_sample", F.round("offset_s", 6).alias("offset_s"))


@query(_OFFSETS + " select file, idx, start_sample - least(48640, start_sample) as read_from, least(48640, start_sample)//1280 as warmup_tokens from o")
def overlap_plan(spark, d):
    return C.overlap_plan(_chunks(spark, d), 3.0).select("file", "idx", "read_from", "warmup_tokens")


@query(
    """with f as (select c_custkey as file, abs(c_acctbal)/50 as s from customer), w as (select file, s, unnest(range(greatest(ceil(s/30)::bigint, 1)))::int as win from f)
    select file, win, round(win*30.0::double, 6) as start_s, round(least(30.0, s - win*30.0::double), 6) as dur_s from w where least(30.0, s - win*30.0::double) >= 0.5"""
)
def window_tiling(spark, d):
    files = read(spark, d, "customer").select(F.col("c_custkey").alias("file"), (F.abs("c_acctbal") / 50).alias("s"))
    return C.windows(files, "file", "s", 30.0).select("file", "win", F.round("start_s", 6).alias("start_s"), F.round("dur_s", 6).alias("dur_s"))


_SIGNAL = """with recursive e as (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as r from embeddings),
x as (select label, r*64 + generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from e),
w as (select label, i, sum(v*v) over g as energy, count(*) over g as n from x window g as (partition by label order by i rows between current row and 19 following)),
es as (select label, list(round(energy, 12) order by i) as es from w where n = 20 group by label), nn as (select label, count(*) as n from x group by label)"""
_CHUNKS = """, b as (select label, cut, row_number() over (partition by label order by cut) - 1 as k from c), z as (select label, k, cut as lo, coalesce(lead(cut) over (partition by label order by k), n) as hi from b join nn using (label))
select label, k::int as chunk_idx, lo::bigint as start_sample, hi::bigint as end_sample from z"""


@query(
    _SIGNAL
    + """, c as (select label, 0::bigint as cut from nn union all select label, case when hi - lo < 20 then lo else lo + list_position(es[lo + 1:hi - 19], list_min(es[lo + 1:hi - 19])) - 1 + 10 end
    from (select c.label, es, n, cut, greatest(cut + 320, cut + 20) as lo, least(cut + 480, n - 20) as hi from c join nn using (label) join es using (label)) where n - cut - 400 > 200 and lo < hi)"""
    + _CHUNKS
)
def energy_cut_chain(spark, d):
    """A label's embeddings one after the other are a signal of 400 samples a second."""
    return C.energy_chunk_rows(_e(spark, d), "label", "vec_id", "embedding", 1.0, 0.2, 400)


@query(
    """with e as (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as r from embeddings),
    x as (select label, r*64 + generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from e), n as (select label, ceil(count(*)*2/5)::bigint as n from x group by label),
    p as (select label, i, v, unnest(range(greatest(ceil((2*i - 80)/5), 0)::bigint, least(floor((2*i + 80)/5) + 1, n)::bigint)) as m from x join n using (label)),
    t as (select label, m, v, m*5 - i*2 as t from p)
    select label, m, round(sum(v * 0.4 * case when t = 0 then 1 else sin(pi()*t/5)/(pi()*t/5) end * (0.5 + 0.5*cos(pi()*t/80))), 6) as v from t group by all"""
)
def resample_signal(spark, d):
    """The same signals at 160 samples a second."""
    blocks = audio.resample_rows(_e(spark, d), "label", "vec_id", "embedding", 400, 160)
    rows = scan.sum_before(blocks, ["label"], ["block"], F.size("samples").cast("bigint"), "first").select("label", "first", F.posexplode("samples").alias("k", "v"))
    return rows.select("label", (F.col("first") + F.col("k")).alias("m"), F.round("v", 6).alias("v"))


_RUNS = "list_filter(flatten(list_transform(range(0, len(seg)), lambda a: list_transform(range(a + 1, len(seg) + 1), lambda b: {'n': a - b, 'a': a, 'ok': list_bool_and(seg[a + 1:b])}))), lambda r: r.ok)"


@query(
    _SIGNAL
    + f""", q as (select label, list(quiet order by f) as q from (select label, i//512 as f, 20*log10(greatest(sqrt(sum(v*v)/512), 1e-10)) <= -18 as quiet from x group by all having count(*) = 512) group by label),
    c as (select label, 0::bigint as cut from nn union all select label, greatest(lo + 1, least(hi - 1, case when best is not null then (lo//512 + best.a + (-best.n)//2)*512
    when hi - 20 - lo < 20 then (lo + hi)//2 else lo + list_position(es[lo + 1:hi - 39], list_min(es[lo + 1:hi - 39])) - 1 + 10 end))
    from (select label, es, lo, hi, list_sort({_RUNS})[1] as best from (select *, q[lo//512 + 1:least(hi//512, len(q))] as seg from
    (select c.label, es, q, n, cut, cut + 1000 as lo, least(cut + 2200, n - 512) as hi from c join nn using (label) join es using (label) join q using (label)) where n - cut - 1600 > 800 and lo < hi)))"""
    + _CHUNKS
)
def vad_cut_chain(spark, d):
    """The same signals with a probability for each full window of 512 samples, by its level."""
    rows = scan.sum_before(_e(spark, d).select("label", "vec_id", "embedding"), ["label"], ["vec_id"], F.lit(1).cast("bigint"), "n")
    window = rows.groupBy("label", F.floor(F.col("n") / (C.VAD_WINDOW // 64)).alias("window")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "embedding"))), lambda s: s["embedding"])).alias("samples"))
    probs = F.transform(G.frame_db(F.col("samples"), C.VAD_WINDOW), lambda v: F.when(v > -18.0, 1.0).otherwise(0.0))
    return C.vad_chunk_rows(window.withColumn("probs", probs), "label", "window", "samples", "probs", 4.0, 1.5, 0.5, 400)


@query()
def model_seam(spark, d):
    from skriva.operators import seam

    chunks = _e(spark, d).select(F.col("label").cast("string").alias("file_id"), F.col("vec_id").cast("int").alias("chunk_idx"), F.col("embedding").alias("samples"), F.lit(100).alias("sample_rate"), F.lit(1).alias("warmup_tokens"))
    return seam.transcribe(chunks)


