"""Operators on small fixtures: invariants and answers known by construction."""

import json
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.operators import align, chunking, cues, joins, registry, seam, stats, sweeps, timing
from skriva.sources import sinks, transcripts
from tests.test_functions import speech

# -- alignment


def test_opcodes_rebuild_the_hypothesis_at_least_cost(monkeypatch):
    rng = random.Random(2)
    for cells in (align.CELLS, 30):
        monkeypatch.setattr(align, "CELLS", cells)
        for _ in range(80):
            a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            ops = align.opcodes(a, b)
            cost = sum(max(s1 - s0, d1 - d0) for t, s0, s1, d0, d1 in ops if t != "equal")
            assert cost == row[-1] == align.distance(a, b)
            assert [(s0, d0) for _, s0, _, d0, _ in ops] == [(s, d) for s, d in zip([0, *(o[2] for o in ops)], [0, *(o[4] for o in ops)], strict=True)][: len(ops)]
            assert all(a[s0:s1] == b[d0:d1] for t, s0, s1, d0, d1 in ops if t == "equal")


PAIRS = [
    ("same", "これはテストです", "これはテストです"), ("words", "We take you through some real things", "we take you, through some real things!"),
    ("short", "あ" * 100, "あ" * 50 + "X" * 5 + "あ" * 50), ("long", "あ" * 100, "あ" * 50 + "X" * 60 + "あ" * 50), ("editorial", "あ" * 100, "あ" * 100 + "い" * 100), ("empty", "", ""),
]


def test_coverage_scores(spark):
    got = {r.k: r for r in align.score_pairs(spark.createDataFrame(PAIRS, "k string, ref string, hyp string")).collect()}
    assert (got["same"].coverage_error, got["same"].coverage, got["same"].extra_ratio, got["same"].unit) == (0, 1, 1, "char")
    assert (got["words"].coverage_error, got["words"].unit) == (0, "word")
    assert got["short"].coverage_error == 0.05
    assert (got["long"].coverage_error, got["long"].insertions_excused, [tuple(x) for x in got["long"].excused_runs]) == (0, 60, [(50, 60)])
    assert got["editorial"].extra_ratio == 2.0
    assert got["empty"].ref_units == 0
    with pytest.raises(ValueError, match="unit"):
        align.score_pairs(spark.createDataFrame(PAIRS, "k string, ref string, hyp string"), unit="page")


def test_lenient_and_kana(spark):
    rows = [("digits", "答えは2018です", "答えはにせんじゅうはちです"), ("kata", "このテストです", "このてすとです"), ("wrong", "ビールを飲みました", "ワインを買いました"), ("spaced", "plain words here", "plain words here"), ("cut", "本日は晴天なり" * 12, "本日は晴天なり" * 6 + "まったく別の話がここに入る" * 4 + "本日は晴天なり" * 6), ("null", None, "x")]
    got = {r.k: r.supplementary for r in align.supplementary(spark.createDataFrame(rows, "k string, ref string, hyp string")).collect()}
    assert got["digits"].lenient_cer < got["digits"].charged_edits / 9
    assert got["kata"].lenient_errors == 0
    assert got["wrong"].lenient_cer > 0
    assert got["wrong"].coverage_kana > 0
    assert got["spaced"] is None
    assert got["cut"].kana_excused > 0
    assert got["cut"].coverage_lenient < 0.25


def test_region_errors_add_up(spark):
    rows = spark.createDataFrame([("a", "abcdefghij" * 5, "abXdefghij" * 4 + "abcde"), ("b", "same", "same")], "k string, ref string, hyp string")
    scored = align.score_pairs(rows, unit="char")
    regions = align.region_errors(scored, "k", 7).groupBy("k").agg(F.sum("edits").alias("e"), F.sum("ref_len").alias("n")).collect()
    want = {r.k: (round(r.error_rate * r.ref_units), r.ref_units) for r in scored.collect()}
    assert {r.k: (r.e, r.n) for r in regions} == want


# -- chunks


@pytest.mark.parametrize("target", [15, 30, 60])
def test_energy_chunks_lose_nothing(spark, target):
    x = speech(150, rate=1600)
    got = spark.createDataFrame([(x.tolist(),)], "s array<double>").select(F.explode(chunking.energy_chunks(F.col("s"), target, 5, 1600)).alias("c")).select("c.*").orderBy("chunk_idx").collect()
    assert got[0].start_sample == 0
    assert got[-1].end_sample == len(x)
    assert all(a.end_sample == b.start_sample for a, b in zip(got, got[1:], strict=False))
    assert all(abs((c.end_sample - c.start_sample) / 1600 - target) <= 5 for c in got[:-1])


def test_short_audio_is_one_chunk():
    assert chunking.energy_cuts(np.zeros(5 * 1600), 60, 5, 1600) == []
    assert chunking.vad_cuts(np.zeros(5 * 1600), np.array([]), 60, 5, rate=1600) == []


def test_vad_cuts_in_the_longest_pause():
    n = 512 * 100
    probs = np.ones(100)
    probs[40:44] = 0
    probs[55:63] = 0
    cuts = chunking.vad_cuts(np.ones(n), probs, target_s=512 * 55 / 16000, search_s=512 * 20 / 16000)
    assert cuts[0] == (55 + 4) * 512


def test_overlap_plan(spark):
    rows = spark.createDataFrame([("f", k, n) for k, n in enumerate([480000, 480000, 1000])], "file string, idx int, n long")
    plan = chunking.overlap_plan(chunking.chunk_offsets(rows, "file", "idx", "n"), 8.0).orderBy("idx").collect()
    assert [r.warmup_tokens for r in plan] == [0, 100, 100]
    assert [r.start_sample - r.read_from for r in plan] == [0, 128000, 128000]
    assert [r.offset_s for r in plan] == [0.0, 30.0, 60.0]
    none = chunking.overlap_plan(chunking.chunk_offsets(rows, "file", "idx", "n"), 0).collect()
    assert {r.warmup_tokens for r in none} == {0}


def test_silence_compaction_and_time_map(spark):
    level = [0.0] * 10 + [-80.0] * 8 + [0.0] * 5 + [-80.0] * 3 + [0.0] * 4
    frames = chunking.silence_frames(spark.createDataFrame([("f", i, v) for i, v in enumerate(level)], "file string, i int, db double"), "file", "i", "db")
    kept = [r.i for r in frames.where("keep").orderBy("i").collect()]
    assert kept == [*range(13), *range(18, 30)]
    mapping = chunking.time_map(frames, "file", "i")
    assert [tuple(round(v, 2) for v in r[1:]) for r in mapping.orderBy("new_start_s").collect()] == [(0.0, 0.0), (1.04, 1.44)]
    asked = spark.createDataFrame([("f", t) for t in (-0.5, 0.0, 1.0, 1.04, 1.5)] + [("other", 1.0)], "file string, t double")
    got = {(r.file, r.t): r.old_s for r in chunking.map_time(asked, mapping, "file", "t").collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {("f", -0.5): -0.5, ("f", 0.0): 0.0, ("f", 1.0): 1.0, ("f", 1.04): 1.44, ("f", 1.5): 1.9, ("other", 1.0): 1.0}
    assert [tuple(r)[1:] for r in chunking.longest_quiet_run(frames, "file", "i").collect()] == [(10, 8, 14)]


# -- cues


def tokens_of(said, step=0.08, pause=None):
    raw = "".join(said).encode()
    t, out = 0.0, []
    for i in range(len(raw)):
        t += 1.0 if pause and i and i % pause == 0 else step
        out.append((raw[i : i + 1], t))
    return out


def test_cues_never_split_a_character():
    said = "".join(chr(0x3042 + i % 40) for i in range(400))
    got = list(cues.cues_of(tokens_of(said)))
    assert "".join(t for *_, t in got) == said
    assert all(0 <= s <= e for s, e, _ in got)
    assert [s for s, *_ in got] == sorted(s for s, *_ in got)


def test_gap_controls_cues():
    said = "".join(chr(0x3042 + i % 40) for i in range(120))
    few, many = (list(cues.cues_of(tokens_of(said, pause=30), cues.Layout(gap_s=g, max_chars=10000, max_dur_s=1e9))) for g in (1.5, 0.7))
    assert len(many) > len(few)
    assert "".join(t for *_, t in many) == "".join(t for *_, t in few) == said


def test_build_and_documents(spark, tmp_path):
    rows = [(f, 0, i, bytes(b), t) for f in ("a", "b") for i, (b, t) in enumerate(tokens_of("はい。" * 20 + f))]
    made = cues.build(spark.createDataFrame(rows, "file_id string, chunk_idx int, pos int, bytes binary, t_s double"))
    srt = {r.file_id: r.document for r in cues.srt(made).collect()}
    back = transcripts.parse_cues(spark.createDataFrame(list(srt.items()), "path string, raw string"))
    assert {r.path: r.n for r in back.groupBy("path").agg(F.count("*").alias("n")).collect()} == {r.file_id: r.n for r in made.groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    doc = json.loads(cues.json_document(made).where("file_id = 'a'").first().document)
    assert doc["text"] == "はい。" * 20 + "a"
    assert [s["id"] for s in doc["segments"]] == list(range(len(doc["segments"])))
    paths = sinks.write_documents(made, str(tmp_path / "out"))
    assert spark.read.text(paths[1], wholetext=True).first().value.startswith("WEBVTT\n\n1\n00:00:00.000 --> ")
    with pytest.raises(ValueError, match="speech times"):
        sinks.write_documents(made, str(tmp_path / "x"), "srt", speech_times=False)
    with pytest.raises(ValueError, match="unknown format"):
        cues.check_format("doc")


def test_sessions_break_only_over_the_gap(spark):
    rows = spark.createDataFrame([("f", t) for t in (0.0, 1.2, 2.5, 2.6)], "f string, t double")
    assert [r.cue_idx for r in cues.sessions(rows, "f", "t", 1.2).orderBy("t").collect()] == [0, 0, 1, 1]


# -- timing


LINES = ["今日はとても良い天気です", "昨日から雨が降っていました", "駅まで歩いて行きましょう", "新しい本を買いました", "明日の会議は十時からです", "コーヒーを一杯ください", "電車が遅れているようです", "窓を開けてもいいですか", "この道をまっすぐ進みます", "夕食の準備ができました"]


def cue_list(shift=0.0, stretch=1.0):
    return [("f", i, max(0.0, (5 + 6 * i) * stretch + shift), max(0.0, (9 + 6 * i) * stretch + shift), LINES[i % 10]) for i in range(40)]


CUE = "file_id string, cue_idx int, start_s double, end_s double, text string"


def test_drift_by_construction(spark):
    ref = spark.createDataFrame(cue_list(), CUE)
    drift = lambda rows: timing.drift_stats(ref, spark.createDataFrame(rows, CUE)).first()
    same = drift(cue_list())
    assert (same.anchor_coverage, same.median_abs_ms, same.p95_abs_ms) == (1.0, 0.0, 0.0)
    assert abs(same.drift_slope_ms_per_min) < 1e-6
    late = drift(cue_list(0.4))
    assert abs(late.constant_offset_ms - 400) < 20
    assert abs(late.drift_slope_ms_per_min) < 30
    slow = drift(cue_list(0, 1.03))
    assert slow.drift_slope_ms_per_min > 500
    assert slow.max_abs_ms > slow.median_abs_ms


def test_breaks(spark):
    ref = spark.createDataFrame(cue_list(), CUE)
    same = timing.break_stats(ref, ref).first()
    assert (same.break_f1, same.mid_phrase_rate) == (1.0, 0.0)
    halves = [("f", 2 * i + k, s + k * (e - s) / 2, s + (k + 1) * (e - s) / 2, t[: len(t) // 2] if k == 0 else t[len(t) // 2 :]) for _, i, s, e, t in cue_list() for k in (0, 1)]
    got = timing.break_stats(ref, spark.createDataFrame(halves, CUE)).first()
    assert got.hyp_cues == 2 * got.ref_cues
    assert got.break_f1 < 0.8
    assert got.mid_phrase_rate > 0.2


def test_band_join_meets_each_pair_once(spark):
    rng = random.Random(0)
    a, b = ([("k", round(rng.uniform(-20, 20), 2)) for _ in range(200)] for _ in range(2))
    left, right = spark.createDataFrame(a, "k string, h double"), spark.createDataFrame(b, "k string, r double")
    got = joins.band(left, right, "h", "r", 0.5, ["k"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.h, r.r) for r in got.collect()) == sorted((x, y) for _, x in a for _, y in b if abs(x - y) <= 0.5)


def test_greedy_is_one_to_one(spark):
    pairs = spark.createDataFrame([("f", 1.0, 1.25), ("f", 1.5, 1.25), ("f", 1.5, 2.0), ("f", 1.0, 2.0)], "k string, a double, b double")
    assert sorted(tuple(r)[1:] for r in joins.greedy(pairs, "k", "a", "b").collect()) == [(1.0, 1.25), (1.5, 2.0)]


def test_seam_zones(spark):
    edits = spark.createDataFrame([("f", t) for t in (1.0, 28.0, 31.0, 45.0)], "f string, t_s double")
    seams = spark.createDataFrame([("f", 30.0)], "f string, seam_s double")
    assert {r.t_s: r.zone for r in timing.seam_zones(edits, seams, "f").collect()} == {1.0: "elsewhere", 28.0: "before", 31.0: "after", 45.0: "elsewhere"}


# -- statistics, registries, sources


def test_tests_and_tables(spark):
    w = spark.createDataFrame([(0, 0), (3, 0), (4, 13), (10, 10)], "a int, b int")
    got = [round(r[0], 4) for r in w.select(stats.sign_test_p("a", "b")).collect()]
    assert got == [1.0, 0.25, 0.049, 1.0]
    t = spark.createDataFrame([(d,) for d in (0, 1, 2, 5, 11, 30, 31)], "d int").select(stats.t_critical(F.col("d"))).collect()
    assert [r[0] for r in t] == [12.706, 12.706, 4.303, 2.571, 2.228, 2.042, 1.96]
    n = spark.createDataFrame([(3,), (7,), (17,), (40,)], "n int").select(stats.distinct_resamples("n")).collect()
    assert [int(r[0]) for r in n][:2] == [10, 1716]
    assert int(n[2][0]) > 1e9


def test_bootstrap_brackets_the_difference(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([("char", i, 100.0 + i, 0.2 + rng.uniform(-0.02, 0.02), 0.1 + rng.uniform(-0.02, 0.02)) for i in range(30)], "unit string, dur int, weight double, ea double, eb double")
    got = stats.interval(stats.bootstrap(rows, "unit", ["dur"], 200), "unit").first()
    assert got.lo < 0.1 < got.hi
    assert got.lo > 0
    assert got.favour == 1.0
    short = stats.block_bootstrap(spark.createDataFrame([("f", i, 1) for i in range(399)], "f string, p int, e int"), "f", "p", "e", 10)
    assert [tuple(r) for r in short.collect()] == [("f", None, None)]


def test_batch_sizes_skip_the_valley(spark):
    rows = spark.range(1, 200).select(F.col("id").cast("int").alias("w")).select("w", registry.snap_batch(F.col("w")).alias("b")).collect()
    assert {r.b for r in rows} <= set(registry.BATCHES)
    assert all(r.b <= r.w for r in rows)


def test_profiles_and_languages(spark):
    m = spark.createDataFrame([("a", "Apple M4", 16, 10, 12.7), ("b", "Apple M2 Ultra", 128, 60, 115.4), ("c", "Apple M3 Pro", 36, 18, 27.0), ("d", None, None, None, None)], "k string, chip string, ram_gb int, gpu_cores int, gpu_working_set_gb double")
    assert {r.k: r.matched for r in registry.resolve_profile(m, "k").collect()} == {"a": "profile", "b": "profile", "c": "derived", "d": "derived"}
    f = spark.createDataFrame([(x,) for x in ("ja", "ja-JP", "JPN", "japanese", "zz", "")], "f string")
    assert [tuple(r) for r in f.select(registry.to_iso(F.col("f")), registry.to_english_name(F.col("f"))).collect()] == [("ja", "Japanese")] * 4 + [(None, None)] * 2


def test_run_documents(spark, tmp_path):
    rows = [{"file": f"f{i}", "duration_s": 100 + 60 * i, "unit": "char", "ref_chars": 100, "coverage_cer": 0.1} for i in range(3)]
    rows += [{"file": "dub", "duration_s": 100.2, "unit": "word", "ref_chars": 50, "coverage_cer": 0.2}, {"file": "again", "duration_s": 99.9, "unit": "char", "ref_chars": 1, "coverage_cer": 0.9}, {"file": "bad", "error": "no"}]
    (tmp_path / "a.json").write_text(json.dumps({"label": "a", "complete": True, "results": rows}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"label": "b", "complete": False, "results": rows[:1]}))
    docs = transcripts.runs(spark, str(tmp_path))
    first = transcripts.run_results(docs)
    assert sorted(r.file for r in first.collect()) == ["dub", "f0", "f1", "f2"]
    assert sorted(r.file for r in transcripts.run_results(docs, duplicates="last").collect()) == ["again", "dub", "f1", "f2"]
    assert transcripts.run_results(docs, incomplete="keep").count() == 5
    with pytest.raises(Exception, match="incomplete run b"):
        transcripts.run_results(docs, incomplete="fail").collect()


def test_sources(spark, tmp_path):
    for n in ("a.wav", "a_transcript.txt", "a.srt", "b.wav", "b.txt", "c.wav", "c.vtt", "d.txt"):
        (tmp_path / n).write_bytes(b"x")
    names = transcripts.listing(spark, str(tmp_path))
    assert {r.stem: r.reference for r in transcripts.pair_files(names).collect()} == {"a": "a_transcript.txt", "b": "b.txt"}
    assert {r.stem: r.reference for r in transcripts.pair_files(names, transcripts.TIMED_REFERENCES).collect()} == {"a": "a.srt", "c": "c.vtt"}
    hyp = spark.createDataFrame([("a.tiny.txt",), ("a.large.v3.txt",), ("z.tiny.txt",), ("a.txt",)], "name string")
    got = transcripts.hypotheses(hyp, spark.createDataFrame([("a",)], "stem string")).collect()
    assert sorted((r.name, r.label) for r in got) == [("a.large.v3.txt", "large.v3"), ("a.tiny.txt", "tiny")]
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(["x\tone", "", "no tab", "x\ttwo\tmore", "none\tignored"])], "place int, value string")
    assert sorted(tuple(r) for r in transcripts.prompt_variants(lines).collect()) == [("none", ""), ("x", "two\tmore")]


def test_subtitles_agree(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nこれはテスト\nです\n\n2\n00:01:00,000 --> 00:01:01,000\nlast"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.500 align:start\nこれはテスト\nです\n\n00:01:00.000 --> 00:01:01.000\nlast"
    got = transcripts.parse_cues(spark.createDataFrame([("a.srt", srt), ("b.vtt", vtt)], "path string, raw string")).collect()
    assert sorted((r.cue_idx, r.start_s, r.end_s, r.text) for r in got if r.path == "a.srt") == sorted((r.cue_idx, r.start_s, r.end_s, r.text) for r in got if r.path == "b.vtt")
    refs = transcripts.references(spark.createDataFrame([("a.srt", srt), ("b.vtt", vtt), ("c.txt", "Ann:\nhello\n\nthere")], "path string, raw string"))
    assert {r.path: r.text for r in refs.collect()} == {"a.srt": "これはテスト\nです\nlast", "b.vtt": "これはテスト\nです\nlast", "c.txt": "hello\nthere"}


def test_wav_rows(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(struct.pack("<3h", 0, 16384, -32768))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    got = {r.path[-5:]: r for r in transcripts.audio(spark, str(tmp_path)).collect()}
    assert got["a.wav"].samples == [0.0, 0.5, -1.0]
    assert got["b.wav"].samples is None
    assert got["b.wav"].error


def test_the_script_is_one_whatever_is_kept_of_the_table(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("aab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        found = []
        for cells in (1, 30, 400, 4_000_000):
            monkeypatch.setattr(align, "CELLS", cells)
            found.append(align.opcodes(a, b))
        assert all(f == found[0] for f in found)


def test_asof_before_the_first(spark):
    left = spark.createDataFrame([("x", 1.0), ("x", 5.0), ("y", 1.0), (None, 2.0), (None, 9.0)], "k string, t double")
    right = spark.createDataFrame([("x", 3.0, "a"), ("x", 4.0, "b"), (None, 8.0, "c")], "k string, at double, v string")
    got = joins.asof(left, right, "t", "at", ["k"], ["v"], first_if_before=True).collect()
    assert sorted(map(str, ((r.k, r.t, r.v) for r in got))) == sorted(map(str, [("x", 1.0, "a"), ("x", 5.0, "b"), ("y", 1.0, None), (None, 2.0, "c"), (None, 9.0, "c")]))


def test_runs_go_on_where_they_ended(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, 0.1, n == "b", None) for n in names], "file string, error double, truncated boolean, looped boolean")
    path = str(tmp_path / "run")
    first = sinks.write_run(rows("a", "b"), path, {"label": "x", "files_expected": 3})
    assert (first["files_scored"], first["complete"], first["truncated"], first["looped"]) == (2, False, ["b"], [])
    last = sinks.write_run(rows("b", "c"), path, {"label": "x", "files_expected": 3})
    assert (last["files_scored"], last["complete"]) == (3, True)
    assert sorted(r.file for r in spark.read.json(f"{path}/results").collect()) == ["a", "b", "c"]
    assert json.loads(spark.read.text(f"{path}/header").first().value) == last


def test_a_cut_character_becomes_a_mark(spark):
    tokens = spark.createDataFrame([("f", 0, 0, bytes([0xE3, 0x81])), ("f", 0, 1, b"a"), ("f", 1, 0, "あ".encode())], "file_id string, chunk_idx int, pos int, bytes binary")
    got = {r.chunk_idx: r.text for r in cues.chunk_texts(tokens).collect()}
    assert got == {0: "\ufffda", 1: "あ"}


def test_forgiven_and_excused_lists(spark):
    pairs = spark.createDataFrame([(1, "カタカナです", "かたかなです"), (2, "カタですがそれから", "かたですがそれから" + "x" * 40)], "k int, ref string, hyp string")
    got = [(r.ref, r.hyp, r.edits, r.times) for r in align.top_forgiven(align.supplementary(pairs)).collect()]
    assert got == [("カタカナ", "かたかな", 4, 1), ("カタ", "かた", 2, 1)]
    scored = align.score_pairs(pairs, unit="char")
    (r,) = align.top_excused(scored, "k", F.split("hyp", "")).collect()
    assert (r.k, r.pos, r.len, r.said) == (2, 9, 40, "x" * 40)


def test_model_seam(spark):
    chunks = spark.createDataFrame([("f", 0, [0.5] * 64, 100, 0), ("f", 1, [0.5] * 64, 100, 2), ("g", 0, [0.0] * 64, 100, 0)], "file_id string, chunk_idx int, samples array<double>, sample_rate int, warmup_tokens int")
    got = seam.transcribe(chunks).collect()
    assert sorted((r.file_id, r.chunk_idx) for r in got) == [("f", 0)] * 8 + [("f", 1)] * 6
    assert min(r.t_s for r in got if r.chunk_idx == 1) == pytest.approx(0.08)


def test_markdown_and_prompts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert sinks.markdown(rows) == "| k | v |\n| --- | --- |\n| a | 1 |\n| b | - |\n\n"
    with pytest.raises(ValueError):
        sinks.markdown(rows, most=1)
    ids = spark.createDataFrame([([1, 2, 3, 4],), ([],)], "e array<int>").select(sweeps.prompt_ids(9, 0, F.lit(2), F.col("e"), 3)).collect()
    assert [r[0] for r in ids] == [[9, 2, 3, 4, 0, 0], [9, 0, 0]]


def test_drift_moves_cues_not_characters(spark):
    """One alignment a file and a row a cue; empty and null cues have no characters, a file without anchors still counts."""
    said = ["ここは長い文章の始まりです", "", None, "そして次の文がここに続きます"]
    rows = [(f, k, t, float(k), k + 1.0) for f in ("a", "b") for k, t in enumerate(said)] + [("none", 0, "短い", 0.0, 1.0), ("ref only", 0, said[0], 0.0, 1.0)]
    ref = spark.createDataFrame(rows, "file_id string, cue_idx int, text string, start_s double, end_s double")
    hyp = ref.where("file_id <> 'ref only'").withColumn("start_s", F.col("start_s") + F.when(F.col("file_id") == "b", 0.25).otherwise(0)).withColumn("end_s", F.col("end_s") + F.when(F.col("file_id") == "b", 0.25).otherwise(0))
    out = timing.drift_stats(ref, hyp)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edit_script(") == 1 and "posexplode" not in plan
    got = {r.file_id: r for r in out.collect()}
    assert set(got) == {"a", "b", "none"}
    assert (got["a"].anchors, got["a"].median_abs_ms, got["a"].anchor_coverage) == (1, 0.0, 1.0)
    assert (got["b"].anchors, got["b"].median_abs_ms, got["b"].p95_abs_ms) == (1, 250.0, 250.0)
    assert (got["none"].anchors, got["none"].p95_abs_ms, got["none"].anchor_coverage) == (0, None, 0.0)
    times = {r.char_pos: r.t_s for r in timing.timeline(ref.where("file_id = 'a'")).collect()}
    (e,) = timing.anchor_errors(ref, hyp).where("file_id = 'a'").collect()
    assert e.at_min == times[e.len // 2] / 60.0 and e.ref_chars == len(times)


def test_greedy_reads_sorted_pairs_of_many_keys(spark):
    rng = random.Random(4)
    rows = [(k if k else None, rng.randrange(6) / 4, rng.randrange(6) / 4) for k in range(60) for _ in range(rng.randint(1, 12))]
    want = []
    for k in {r[0] for r in rows}:
        used = set(), set()
        for _, x, y in sorted((abs(x - y), x, y) for j, x, y in rows if j == k):
            if x not in used[0] and y not in used[1]:
                want.append((k, x, y))
                used[0].add(x), used[1].add(y)
    out = joins.greedy(spark.createDataFrame(rows, "k int, a double, b double"), "k", "a", "b")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()  # a frame a key costs more than its matches
