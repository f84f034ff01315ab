"""Readings: the double array against a set of strings, paths against all segmentations, tables against one reader."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skriva.functions import kana, lattice
from skriva.functions.lattice import DoubleArray, Reader
from skriva.operators import align, readings


def by_definition(text, rows, unknown):
    """The cheapest path, place by place; of equal costs the longest last word."""
    words = {}
    for s, r, c in rows:
        words[s] = min(words.get(s, (c, r)), (c, r))
    best = [(0, "")]
    for j in range(1, len(text) + 1):
        ways = [(best[i][0] + words[text[i:j]][0], i - j, best[i][1] + words[text[i:j]][1]) for i in range(j) if text[i:j] in words]
        ways.append((best[j - 1][0] + unknown, -0.5, best[j - 1][1] + text[j - 1]))  # alone only where nothing is as cheap
        cost, _, said = min(ways)
        best.append((cost, said))
    return best[-1][1]


def made(rng, letters):
    return [("".join(rng.choices(letters, k=rng.randint(1, 4))), rng.choice("あいうえお") * rng.randint(0, 3), rng.randint(0, 6)) for _ in range(rng.randint(0, 14))]


def test_the_double_array_holds_its_surfaces_and_no_others():
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(700)]
    surfaces = sorted({"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(4000)})
    words = DoubleArray(surfaces)
    some = rng.sample(surfaces, 500) + ["".join(rng.choices(letters + ["x"], k=rng.randint(1, 4))) for _ in range(500)]
    held = {s: k for k, s in enumerate(surfaces)}
    for s in some:
        start, end, word = words.matches(np.array([ord(c) for c in s], np.uint32))
        want = {(i, j, held[s[i:j]]) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i:j] in held}
        assert set(zip(start.tolist(), end.tolist(), word.tolist(), strict=True)) == want


def test_paths_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(600):
        letters = "日本語一二"[: rng.randint(1, 5)]
        rows, unknown = made(rng, letters), rng.choice([3, 10_000])
        texts = ["".join(rng.choices(letters + "a", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        assert Reader(rows, unknown).read(texts) == [by_definition(t, rows, unknown) for t in texts]


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(4)
    rows = [("日本", "にほん", 1), ("本日", "ほんじつ", 1), ("日", "ひ", 2)]
    texts = ["".join(rng.choices("日本。", k=n)) for n in (0, 3, 400, 90)] + ["日本" * 100]
    want = [by_definition(t, rows, 50) for t in texts]
    monkeypatch.setattr(lattice, "CHARS", 20)
    assert Reader(rows, 50).read(texts) == want


@pytest.mark.parametrize("block_rows", [1000, 2])
def test_a_table_is_read_alike_in_one_block_and_in_many(spark, block_rows):
    rows = [("日本", "ニホン", 1), ("日本", "にっぽん", 5), ("本日", "ほんじつ", 1), ("日", "ひ", 2), ("今日", "きょう", 1), ("年", "ねん", 1)]
    odd = [(None, "x", 1), ("", "x", 1), ("月", None, 1), ("火", "か", None)]
    dictionary = spark.createDataFrame(rows + odd, "surface string, reading string, cost long")
    texts = [None, "", "今日は日本", "本日火月", "2018年カナ", "未知", "日本日", "a\0日"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, text string, reading string")
    got = {r.id: r.said for r in readings.with_readings(docs, "text", dictionary, out="said", read_digits=True, unknown=50, block_rows=block_rows).collect()}
    assert got[0] is None and got[1] == "" and got[3] == "ほんじつ火月" and got[5] == "未知"  # what no word covers stays
    assert got[2] == "きょうはにほん" and got[4] == "にせんじゅうはちねんかな" and got[7] == "a\0ひ"
    assert got == {k: None if t is None else kana.fold(by_definition(kana.read_all_digits(t), rows, 50)) for k, t in enumerate(texts)}


def test_an_empty_dictionary_reads_kana(spark):
    empty = spark.createDataFrame([], "surface string, reading string, cost long")
    (r,) = readings.with_readings(spark.createDataFrame([("カナ漢字",)], "t string"), "t", empty).collect()
    assert r.reading == "かな漢字"
    assert readings.whole_reader(empty).value.read(["漢"]) == ["漢"]


def test_a_reader_for_all_tasks_is_of_a_checked_size(spark):
    rows = spark.createDataFrame([("一", "いち", 1), ("二", "に", 1), ("二", "ふた", 2)], "surface string, reading string, cost long")
    assert readings.whole_reader(rows, limit=2).value.read(["一二"]) == ["いちに"]
    with pytest.raises(ValueError, match="more than 1"):
        readings.whole_reader(rows, limit=1)


def test_kanji_count_as_the_kana_they_are_read_as(spark):
    words = [("一", "ひと", 1), ("今日", "きょう", 1), ("京", "きょう", 1), ("天気", "てんき", 1), ("転機", "てんき", 1), ("年", "ねん", 1)]
    reader = Reader(words)
    assert kana.same_reading("今日", "きょう", reader=reader) and kana.same_reading("一つ", "ひとつ", reader=reader)
    assert not kana.same_reading("今日", "京", reader=reader)  # two kanji words
    assert not kana.same_reading("今日", "きョう", reader=reader)  # two kana scripts
    assert not kana.same_reading("今日", "きょう")  # nothing reads it
    assert kana.same_reading("12年", "じゅうにねん", True, reader)
    dictionary = spark.createDataFrame(words, "surface string, reading string, cost long")
    pairs = spark.createDataFrame([("今日はとてもよい天気です", "きょうはとてもよいてんきです"), ("今日はとてもよい天気です", "今日はとてもよい転機です"), (None, "x")], "ref string, hyp string")
    a, b, c = (r.supplementary for r in align.supplementary(pairs, dictionary=dictionary).collect())
    assert (a.lenient_errors, a.coverage_kana, a.coverage_lenient) == (0, 0.0, 0.0) and [(v.ref, v.hyp) for v in a.variants] == [("今日", "きょう"), ("天気", "てんき")]
    assert (b.lenient_errors, b.coverage_kana) == (2, 0.0) and b.error is None and c.lenient_errors is None
    plain = align.supplementary(pairs).collect()[0].supplementary
    assert plain.lenient_errors > 0 and plain.coverage_kana > 0


def test_batched_scores_equal_those_of_one_pair(spark):
    rng = random.Random(6)
    rows = made(rng, "日本語")
    pairs = [("".join(rng.choices("日本語あいアイ。12", k=rng.randint(0, 30))), "".join(rng.choices("日本語あいアイ。12", k=rng.randint(0, 40)))) for _ in range(40)]
    got = align.supplementary(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id int, ref string, hyp string"), min_cut=6, dictionary=spark.createDataFrame(rows, "surface string, reading string, cost long")).orderBy("id").collect()
    reader, strip = Reader(rows), lambda t: t.replace("。", "")
    for r, (a, b) in zip(got, pairs, strict=True):
        a, b, s = strip(a), strip(b), r.supplementary
        if s is None:  # hardly any kana or kanji
            continue
        errors, forgiven, detail = align.lenient(a, b, read_digits=True, reader=reader)
        assert (s.lenient_errors, s.forgiven, [tuple(v) for v in s.variants]) == (errors, forgiven, detail)
        assert (s.coverage_kana, s.kana_excused) == align.coverage_kana(a, b, 6, reader=reader)
        rate, _, charged = align.coverage_lenient(a, b, 6, reader=reader)
        assert (s.coverage_lenient, s.charged_edits) == (rate, charged)


def test_a_batch_is_python_objects_a_slice_at_a_time(monkeypatch):
    texts = pa.array(["漢" * (k % 50) if k % 7 else None for k in range(3000)]).slice(5)
    monkeypatch.setattr(readings, "SLICE", 4096)
    seen = []
    got = readings.by_slices(lambda ts: [seen.append(sum(len(t or "") * 3 for t in ts)) or t for t in ts], texts)
    assert got.to_pylist() == texts.to_pylist() and max(seen) <= 4096
    runs = list(readings.slices(texts, texts))
    assert [lo for lo, _ in runs] == [0, *(lo + n for lo, n in runs)][:-1] and sum(n for _, n in runs) == len(texts)
    assert not list(readings.slices(texts.slice(0, 0)))
