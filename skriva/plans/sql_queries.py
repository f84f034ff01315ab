"""The registered functions used from SQL text, cues as files, and cues on a remapped time line."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skriva.functions import registered
from skriva.operators import cues as C
from skriva.operators.lineage import shared_dir
from skriva.plans.cue_queries import _CUES, _cues, _ts
from skriva.plans.registered import ORACLES, query, read
from skriva.sources import cue_source


@query(ORACLES["parse_cues"])
def sql_parse_cues(spark, d):
    registered.register(spark)
    files = C.srt(_cues(spark, d), width=1 << 20)
    return spark.sql("SELECT file_id, c.cue_idx, round(c.start_s, 3) AS start_s, round(c.end_s, 3) AS end_s, cast(length(c.text) AS bigint) AS n_chars FROM {files}, LATERAL parse_cues(document) c", files=files)


@query(ORACLES["parse_cues"])
def cue_files(spark, d):
    """The same cues written as files and read back through the data source."""
    cue_source.register(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/cues-{uuid.uuid4().hex}"
    C.srt(_cues(spark, d), width=1 << 20).select("file_id", "document").write.format("cues").mode("append").save(folder)
    back = spark.read.format("cues").load(folder)
    file = F.regexp_extract("path", r"([^/]+)[.]srt$", 1).cast("bigint")
    return back.select(file.alias("file_id"), "cue_idx", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.length("text").cast("bigint").alias("n_chars"))


@query(ORACLES["energy_cut_chain"])
def sql_energy_chunks(spark, d):
    registered.register(spark)
    blocks = read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    return spark.sql("SELECT * FROM energy_chunks(TABLE({blocks}), 1.0, 0.2, 400)", blocks=blocks)


@query("select doc_id, k::int as region, (k * length(text) // 10)::int as first, ((k + 1) * length(text) // 10)::int as stop from documents, (select unnest(range(10)) as k)")
def sql_regions(spark, d):
    registered.register(spark)
    return spark.sql("SELECT doc_id, r.* FROM {docs}, LATERAL split_regions(length(text), 10) r", docs=read(spark, d, "documents"))


@query(
    f"""select conv_id, turn, {_ts("turn * 37.1234::double", ".")} as at, ((length(text) - length(replace(text, 'en', ''))) // 2)::bigint as hits,
    round(levenshtein(regexp_replace(text, '[^a-z]', '', 'g'), role) / greatest(length(regexp_replace(text, '[^a-z]', '', 'g')), 1), 6) as rate from conversations"""
)
def sql_expressions(spark, d):
    registered.register(spark)
    turns = read(spark, d, "conversations")
    return spark.sql("SELECT conv_id, turn, cue_timestamp(turn * 37.1234D, '.') AS at, term_hits(text, 'en') AS hits, round(plain_error_rate(regexp_replace(text, '[^a-z]', ''), role), 6) AS rate FROM {turns}", turns=turns)


@query(
    _CUES
    + """, m as (select file_id, start_s as new_start_s, start_s*2 + 5 as old_start_s from cues where cue_idx % 3 = 1),
    f as (select file_id, arg_min(m, new_start_s) as first from m group by file_id),
    t as (select file_id, cue_idx, unnest(['start', 'end']) as side, unnest([start_s, end_s]) as t from cues),
    j as (select t.*, m.new_start_s as n, m.old_start_s as o from t asof left join m on t.file_id = m.file_id and t.t >= m.new_start_s),
    r as (select j.file_id, cue_idx, side, coalesce(coalesce(o, first.old_start_s) + (t - coalesce(n, first.new_start_s)), t) as t from j left join f using (file_id))
    select file_id, cue_idx, round(max(t) filter (side = 'start'), 6) as start_s, round(max(t) filter (side = 'end'), 6) as end_s from r group by all"""
)
def cue_remap(spark, d):
    """Cues of a compacted line back on the original one, by a map that begins at every third cue."""
    cues = _cues(spark, d)
    mapping = cues.where("cue_idx % 3 = 1").select("file_id", F.col("start_s").alias("new_start_s"), (F.col("start_s") * 2 + 5).alias("old_start_s"))
    return C.remapped(cues, mapping).select("file_id", "cue_idx", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))
