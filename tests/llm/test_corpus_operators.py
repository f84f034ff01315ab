"""Operators over whole tables: archives, passages, wrappers, languages, the pipeline."""

import base64
import hashlib
import random
import re
import struct

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from pyspark.sql import functions as F
from skriva.llm import langid, passages, warc
from skriva.llm.support import components, small_side

# -- archives


PAGES = [(5, "http://a/5", "<p>x</p>"), (1, "http://a/1\n2", "é" * 300_000), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (2, "v", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 1, 100])
def test_archives_read_back(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, bundle string, frame int").repartition(3)
    folder = str(tmp_path / "w")
    index = warc.write_bundles(pages, folder, min_revisit=least)
    got = warc.read_bundles(spark, folder).collect()
    assert all(r.sound for r in got)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, x in PAGES if (x or "").encode() == raw and j is not None]
        first = i is None or len(raw) < least or i == min(same)
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", "None" if first else str(min(same))))
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    found = warc.lookup(spark, folder, index, spark.createDataFrame([(1,), (9,)], "id long")).collect()
    assert sorted(r.id for r in found) == ["1", "9", "9"]
    assert next(r for r in found if r.id == "1").payload.decode() == "é" * 300_000


def test_bundles_are_seekable_zstandard(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 4000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, str(tmp_path / "w")).collect()
    (file,) = (tmp_path / "w").glob("part-*.warc.zst")
    raw = file.read_bytes()
    table = warc.frames(raw)
    assert len(table) > 3
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(whole) == sum(d for _, _, d in table)  # readers without the table see one stream
    r = next(x for x in index if x.id == "37")
    (one,) = warc.parse(warc.frame(raw, table[r.frame]), r.at, r.at + r.size)
    assert one["payload"] == b"<p>37</p>" * 4000


def test_a_lookup_reads_the_footer_and_one_frame(spark, tmp_path):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=200_000))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, str(tmp_path / "w")).collect()
    (path,) = (tmp_path / "w").glob("part-*.warc.zst")

    class Counting:
        def __init__(self):
            self.file, self.read_bytes = path.open("rb"), 0

        def size(self):
            return path.stat().st_size

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.read_bytes += n
            return self.file.read(n)

    r = next(x for x in index if x.id == "17")
    file, (_, packed, _) = Counting(), warc.frames(path.read_bytes())[r.frame]
    (got,) = warc.fetch(file, [{"frame": r.frame, "at": r.at, "size": r.size}])
    assert got["id"] == "17" and got["sound"]
    assert file.read_bytes < packed + 2000 < path.stat().st_size / 5


def test_no_pages_no_bundles(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_bundles(empty, str(tmp_path / "w")).count() == 0
    assert warc.read_bundles(spark, str(tmp_path / "w")).count() == 0


# -- passages


def brute_windows(v, width):
    out = set()
    for i in range(len(v) - width + 1):
        for j in range(i + width, len(v) + 1):
            c = i + int(np.argmin(v[i:j]))
            out.add((i, j - 1, c))
    return out


def test_compact_windows_hold_every_subsequence():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n).astype(np.uint64) << np.uint64(40) for n in (0, 3, 25, 40, 9)]
    v, first = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    l, c, r = passages.compact_windows(v, first, 6)
    for t, lo in zip(texts, first, strict=False):
        mine = [(a - lo, b - lo, e - lo) for a, b, e in zip(l, c, r, strict=True) if lo <= b < lo + len(t)]
        for i, j, k in brute_windows(t, 6):  # each subsequence lies in the one window of its minimum
            assert [(a, b, e) for a, b, e in mine if a <= i and j <= e and i <= b <= j] == [x for x in mine if x[1] == k]
            assert sum(x[1] == k for x in mine) == 1


def docs_with_repeats(rng):
    word = lambda: f"w{rng.randint(0, 10**6)}"
    text = lambda n: [word() for _ in range(n)]
    shared, short, common = text(70), text(30), text(120)
    docs = {i: text(rng.randint(0, 200)) for i in range(1, 30)}
    for i in (3, 8, 15):
        at = rng.randint(0, len(docs[i]))
        docs[i][at:at] = shared
    for i in range(1, 30):
        if i % 2:
            docs[i] += short  # too short to count, and common
    docs[20] = docs[21] = common
    near = list(common)
    near[60] = "changed"
    docs[22] = near
    return docs, {3: (None, shared), 8: (3, shared), 15: (3, shared), 21: (20, common), 22: (20, common)}


def test_repeats_are_found_and_cut(spark):
    docs, planted = docs_with_repeats(random.Random(1))
    rows = [(i, " ".join(w).upper() if i == 8 else "\n".join(w), None, 0) for i, w in docs.items()] + [(90, None, None, 0), (91, "", None, 0), (None, " ".join(docs[3]), None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cut_at string, places int")
    found = passages.repeated_passages(frame)
    got = {(r.id, r.partner): r.passages for r in found.collect()}
    assert set(got) == {(i, p) for i, (p, _) in planted.items() if p}
    for (i, p), spans in got.items():
        held = {w.lower() for s in spans for w in docs[i][s.start : s.end]}
        assert len(held & {w.lower() for w in planted[i][1]}) >= 0.95 * len(planted[i][1]), (i, p)
    out = passages.cut_passages(frame, found)
    assert out.schema == frame.schema
    kept = {r.doc_id: r.text for r in out.collect()}
    assert 21 not in kept
    assert len(kept[8].split()) == len(docs[8]) - len(planted[8][1])
    assert kept[3] == "\n".join(docs[3])
    assert kept[90] is None


def test_a_common_phrase_hides_no_passage(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    phrase = [word() for _ in range(40)]
    docs = {i: [word() for _ in range(40)] + phrase + [word() for _ in range(40)] for i in range(1, 40)}
    docs[31][30:90] = docs[30][30:90]  # shares ten words on either side of the phrase as well
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {(r.id, r.partner) for r in passages.repeated_passages(frame).collect()}
    assert got == {(31, 30)}


def test_components_of_chains(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 7)]
    rng.shuffle(pairs)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i - i % 20 for i in range(60)} | {100: 0}


def test_small_side_is_checked(spark):
    rows = spark.range(100)
    plan = lambda limit: spark.range(50).join(small_side(rows, 8, limit), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(800)
    assert "broadcast" not in plan(799)


# -- languages


def test_languages(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ein", "ü", "der"], "fr": ["eau", "que", "é", "les", "ou"]}
    said = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(i, said(lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(list(parts), k=400))]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", "de"), (902, said("fr", 20), None), (None, "the thing", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 396
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[900].rejected and got[901].rejected
    assert sum(got[i].rejected for i, _, _ in rows) <= 0.05 * len(rows)  # about REJECT of known languages
    mixed = [(i, " ".join(said(lang, 1) for lang in parts for _ in range(5))) for i in range(50)]
    odd = spark.createDataFrame(mixed, "doc_id long, text string")
    assert langid.identify(odd, model).where("rejected").count() > 25
    nothing = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.rejected) for r in langid.identify(odd, nothing).collect()} == {("und", True)}
    assert langid.identify(docs.limit(0), model).count() == 0
    again = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20")).withColumn("score", F.lit("clash"))
    assert langid.identify(again, model).distinct().count() == 20
    long = said("de", 3000)
    assert langid.identify(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first().lang_pred == "de"


def test_grams_join_over_blocks(monkeypatch):
    text = " ".join(random.Random(2).choices(["Ärger", "x", "die, und", "ñandú  "], k=400)).encode()
    table = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], table, np.zeros(3, np.float32))
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = langid.scores(model, data, off)
    monkeypatch.setattr(langid.K, "BLOCK", 37)
    assert np.allclose(langid.scores(model, data, off), whole)


# -- the pipeline


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True)
    assert seen[-1] > 0.6 * seen[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert {r.doc_id: r.ids_sha256 for r in last} == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_registered_names():
    from skriva.llm import queries

    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_hot_keys_change_nothing(spark, monkeypatch):
    docs, planted = docs_with_repeats(random.Random(7))
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(100 + i, " ".join(docs[20])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda: {(r.id, r.partner): [tuple(p)[:2] for p in r.passages] for r in passages.repeated_passages(frame).collect()}
    calm = result()
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "HOT", 2)
    monkeypatch.setattr(passages, "SHARE", 2)
    assert len(passages.hot_keys(passages.coded(frame))[0]) > 5
    salted = result()
    linked = lambda found: {i for i, _ in found}
    assert linked(salted) == linked(calm) == {i for i, (p, _) in planted.items() if p} | {100 + i for i in range(40)}
    assert all(any(s == (0, 120) for s in salted[k]) for k in salted if k[0] >= 100)


def test_pipeline_takes_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    said = lambda n: " ".join(f"word{rng.randint(0, 400)}" for _ in range(n))
    docs = [(i, said(80), "en") for i in range(30)] + [(1, said(80), "en"), (40, None, None), (41, "", "en"), (None, said(60), None), (42, said(40_000), "de")]
    labels = [(i, int(i % 5 > 0), 0, "x") for i in range(30)]
    spark.createDataFrame([(*d, "key", 1) for d in docs], "doc_id long, text string, lang string, key string, drop_id int").write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(str(tmp_path / "a/labels.parquet"))
    spark.createDataFrame([(1, "some question of thirteen words")], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert 20 <= len(got) <= len(docs)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"a/{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"b/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
