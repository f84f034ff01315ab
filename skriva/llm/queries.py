"""The registered queries opN_<name>: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.llm.repetition import LINE_SHARE, NGRAM_SHARES
from skriva.llm.support import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm.decontaminate import contaminated, decontaminate

    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import warc

    folder = warc.archive_folder(spark)
    warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    r = warc.read_bundles(spark, folder, payloads=False)
    return r.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out())), evidence=3)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skriva.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm.passages import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    p = found.select(F.col("id").alias("doc_id"), F.col("partner").alias("partner_id"), F.explode("passages").alias("p"))
    return p.select("doc_id", "partner_id", "p.start", "p.end", "p.partner_start", "p.partner_end", F.round("p.similarity", 6).alias("similarity"))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text leaves 0 modulo 5; so are rows without id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import wrappers

    pages = table(spark, sf_dir, "pages")
    return wrappers.extract_pages(pages, wrappers.learn(pages)).select("page_id", "url", "text", "n_chars", "matched")


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import resample
    from skriva.llm.support import cut

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = resample.fit(docs, labels)
    keys = cut(resample.scored(docs, model))
    return keys.select("doc_id", "log_weight", "key", (F.col("key") >= resample.threshold(keys, model)).alias("kept"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import shards

    written = shards.write_shards(table(spark, sf_dir, "documents"))
    return written.select(
        "doc_id", shards.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_txlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import txlog

    changes, commits = txlog.resolve(txlog.document_log(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    states = txlog.states(changes, commits).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").alias("n"), F.col("total").alias("value"))
    undone = changes.where("fate <> 'commit'").select(F.col("fate").alias("kind"), F.col("at").alias("id"), F.col("by_at").alias("n"), F.col("key").alias("value"))
    return states.unionByName(undone)


def op13_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skriva.llm import treaps

    return treaps.search(treaps.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_repetition, op4_toxicity, op5_bpe, op6_passages, op7_langid, op8_simhash, op9_wrappers, op10_resample, op11_shards, op12_txlog, op13_treaps)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_COVER = "max({flag}) over (partition by doc_id order by pos rows between {back} preceding and current row)"


def _crc_table() -> str:
    """The 256 steps of CRC-32, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return f"{table}::ubigint[]"


def _crc(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text."""
    step = f"lambda a, x: xor(({_crc_table()})[(xor(a, x) & 255)::bigint + 1], a >> 8)"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::ubigint), {step}, 4294967295::ubigint), 4294967295::ubigint)::bigint"


def _grams(lengths: tuple[int, ...]) -> str:
    """CTEs g{n}: each word with whether it lies in a window of n words that recurs (again) or occurred before (later)."""
    parts = []
    for n in lengths:
        whole = f"pos + {n} <= n_words"
        parts.append(
            f"""f{n} as (select doc_id, pos, size, case when {whole} then count(*) over (partition by doc_id, gram) end as times, case when {whole} then row_number() over (partition by doc_id, gram order by pos) end as nth
            from (select *, case when {whole} then array_to_string(w[pos + 1:pos + {n}], chr(10)) end as gram from words)),
            g{n} as (select doc_id, size, coalesce({_COVER.format(flag="(times > 1)::int", back=n - 1)}, 0) as again, coalesce({_COVER.format(flag="(nth > 1)::int", back=n - 1)}, 0) as later from f{n}),
            s{n} as (select doc_id, sum(again)::bigint as n_again, sum(later * size)::bigint as later_chars from g{n} group by doc_id)"""
        )
    return ", ".join(parts)


ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""with i as (select item_id::varchar as item_id, {_NORMAL} as w from benchmark where item_id is not null),
        p as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[k + 1:k + least(len(w), 13)], ' ') as window from (select item_id, w, unnest(range(greatest(len(w) - 12, least(len(w), 1)))) as k from i)),
        d as (select doc_id, {_NORMAL} as w from documents), n as (select distinct n from p),
        spots as (select doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) as k from d, n),
        hit as (select doc_id, k, spots.n, item_id from spots join p on p.n = spots.n and p.window = array_to_string(w[k + 1:k + spots.n], ' ')),
        words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from (select distinct doc_id, k, n from hit)) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join words using (doc_id) left join items using (doc_id)""",
    "op2_warc": """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as least from pages)
        select page_id, strlen(html)::bigint as payload_bytes,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31) + 1)::bigint, 1)), 'string_agg', '') as payload_digest,
        case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id > least then least end as refers_to from p""",
    "op3_repetition": f"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        words as (select doc_id, w, len(w) as n_words, unnest(range(len(w))) as pos, length(unnest(w)) as size from d),
        {_grams((3, *NGRAM_SHARES))},
        l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d),
        m as (select doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) as size, row_number() over (partition by doc_id, line order by k) as nth from l),
        lines as (select doc_id, count(*) as n, sum(size)::bigint as chars from m where nth > 1 and size > 0 group by doc_id),
        c as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(lines.chars, 0) as line_chars, coalesce(s3.n_again, 0)::bigint as n_repeat_words, {", ".join(f"coalesce(s{n}.later_chars, 0) as c{n}" for n in NGRAM_SHARES)}
        from d left join lines using (doc_id) left join s3 using (doc_id) {" ".join(f"left join s{n} using (doc_id)" for n in NGRAM_SHARES)}),
        b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and line_chars <= {LINE_SHARE}::double * word_chars and {" and ".join(f"c{n} <= {share}::double * word_chars" for n, share in NGRAM_SHARES.items())} as kept from b""",
    "op12_txlog": f"""with recursive h as (select doc_id, coalesce('=' || source, '') as source, text, {_crc("doc_id::varchar")} as h from documents where doc_id is not null),
        t as (select distinct doc_id from labels where toxic = 1),
        r as (select doc_id, source, row_number() over (partition by source order by doc_id) as k,
        case when h % 23 < 2 then 'commit' when h % 23 = 2 then 'abort' when h % 23 < 5 then 'savepoint' when h % 23 < 7 then 'rollback' else 'change' end as op, (h // 100) % 300 as key,
        case when h % 23 >= 7 and text is not null and t.doc_id is null then {_crc("((h // 100) % 300)::varchar || ':' || text")} end as value from h left join t using (doc_id)),
        x as (select source, 0::bigint as k, [[]::bigint[]] as stack, []::bigint[] as gone, '' as op, null::bigint as by_id from (select distinct source from r)
        union all select r.source, r.k, case r.op when 'change' then stack[1:len(stack) - 1] || [list_append(stack[len(stack)], r.doc_id)] when 'savepoint' then stack || [[]::bigint[]]
        when 'rollback' then case when len(stack) > 1 then stack[1:len(stack) - 1] else [[]::bigint[]] end else [[]::bigint[]] end,
        case r.op when 'rollback' then stack[len(stack)] when 'change' then [] when 'savepoint' then [] else flatten(stack) end, r.op, r.doc_id from x join r on r.source = x.source and r.k = x.k + 1),
        ended as (select unnest(gone) as doc_id, op as fate, by_id from x union all select unnest(flatten(arg_max(stack, k))), 'abort', null from x group by source),
        c as (select doc_id as by_id, (row_number() over (order by doc_id) - 1) // 4 + 1 as epoch from r where op = 'commit'),
        a as (select epoch, by_id, doc_id, key, value from ended join c using (by_id) join r using (doc_id) where fate = 'commit'),
        s as (select e.epoch, value from (select distinct epoch from c) e join a on a.epoch <= e.epoch qualify row_number() over (partition by e.epoch, key order by by_id desc, doc_id desc) = 1)
        select 'state' as kind, epoch as id, count(value)::bigint as n, coalesce(sum(value), 0)::bigint as value from (select distinct epoch from c) left join s using (epoch) group by epoch
        union all select fate, doc_id, by_id, key::bigint from ended join r using (doc_id) where fate <> 'commit'""",
    "op13_treaps": f"""with d as (select row_number() over () as rid, doc_id, {_NORMAL} as w from documents where doc_id is not null),
        s as (select count(*) filter (len(w) > 0) as big_n, coalesce(sum(len(w)), 0)::bigint as l from d),
        p as (select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) group by all), f as (select term, count(*) as df from p group by term),
        i as (select item_id, term, count(*) as times from (select item_id, unnest({_NORMAL}) as term from benchmark where item_id is not null) group by all),
        x as (select item_id, rid, doc_id, sum(times * floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(w) * big_n) // l))))::bigint as score
        from i join f using (term) join p using (term) join d using (rid), s group by all)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from x where score > 0 qualify rank <= 10""",
}
