"""Column functions: known answers and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.functions import kana, signal, text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def speech(seconds, seed=0, rate=16000):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.002, int(seconds * rate))
    at = 0
    while at < len(x):
        n = int(rng.uniform(1, 4) * rate)
        x[at : at + n] += rng.normal(0, 0.2, len(x[at : at + n]))
        at += n + int(rng.uniform(0.3, 1.5) * rate)
    return np.clip(x, -1, 1)


def test_levels_match_numpy(spark):
    x = speech(1.0)
    rows = spark.createDataFrame([(x.tolist(),)], "s array<double>")
    got = rows.select(signal.peak_dbfs(F.col("s")).alias("p"), signal.frame_db(F.col("s")).alias("f"), signal.apply_gain(F.col("s"), "rms").alias("r")).first()
    assert got.p == pytest.approx(20 * math.log10(np.abs(x).max()))
    n = len(x) // 1280
    fs = x[: n * 1280].reshape(n, 1280)
    db = 20 * np.log10(np.sqrt((fs**2).mean(1)))
    assert np.allclose(got.f, db)
    active = fs[db > np.percentile(db, 60)]
    want = np.clip(x * 10 ** (-23 / 20) / np.sqrt((active**2).mean()), -1, 1)
    assert np.allclose(got.r, want)


@pytest.mark.parametrize("peak", [-8, -12, -20, -40])
def test_auto_gain_lifts_quiet_audio(spark, peak):
    x = speech(0.3)
    x = x / np.abs(x).max() * 10 ** (peak / 20)
    y = np.array(one(spark, signal.apply_gain(F.col("s"), "auto"), s=x.tolist()))
    assert abs(20 * math.log10(np.abs(y).max()) + 1.0) < 0.2


def test_healthy_audio_and_silence_stay(spark):
    x = [0.9, -0.1, 0.2]
    assert one(spark, signal.apply_gain(F.col("s"), "auto"), s=x) == x
    assert one(spark, signal.chunk_gain_db(F.col("s")), s=[0.0] * 10) == 0
    empty = spark.createDataFrame([([],), (None,)], "s array<double>")
    assert [tuple(r) for r in empty.select(signal.auto_gain_db(F.col("s")), F.size(signal.frame_db(F.col("s")))).collect()] == [(0.0, 0), (0.0, 0)]


NUMBERS = {
    "0": "れい", "10": "じゅう", "300": "さんびゃく", "2018": "にせんじゅうはち", "10000": "いちまん", "1,500": "せんごひゃく", "3.5": "さんてんご", "8600": "はっせんろっぴゃく", "3000": "さんぜん", "11": "じゅういち",
    "100000000": "いちおく", "007": "れいれいなな", "２０": "にじゅう", "x": "x",
}


@pytest.mark.parametrize(("digits", "reading"), NUMBERS.items())
def test_numbers_read(digits, reading):
    assert kana.read_number(digits) == reading


@pytest.mark.parametrize("digits", ["0" * 40, "1" * 25, "9" * 64, "00", "1.2.3", "", "."])
def test_hostile_digits_never_raise(digits):
    out = kana.read_number(digits)
    if digits.isdigit():
        assert not any(c.isdigit() for c in out)


def test_same_reading():
    assert kana.same_reading("2018", "にせんじゅうはち", True)
    assert kana.same_reading("テスト", "てすと")
    assert not kana.same_reading("ビール", "びーる")  # the long-vowel mark counts as katakana
    assert not kana.same_reading("ビール", "ワイン")
    assert not kana.same_reading("漢字", "感じ")


def test_normalisation(spark):
    assert one(spark, text.normalize_chars(F.col("s")), s="ＡＢ、ｃ　。 d e ー!") == "ABcdeー"
    assert one(spark, text.normalize_words(F.col("s")), s="  Take you\nthrough, (SOME) real…") == "take you through some real"
    assert one(spark, text.tokenize(F.col("s")), s="We're été_ok 12") == ["we're", "été", "ok", "12"]
    assert one(spark, text.unit_of(F.col("s")), s="これはテスト") == "char"
    assert one(spark, text.unit_of(F.col("s")), s="") == "char"
    assert one(spark, text.unit_of(F.col("s")), s="plain words") == "word"


def test_formats(spark):
    assert one(spark, text.timestamp(F.col("s")), s=3661.0005) == "01:01:01,000"
    assert one(spark, text.timestamp(F.col("s"), "."), s=360000.25) == "100:00:00.250"
    assert one(spark, text.wrap(F.col("s"), 2), s="あいうえお") == "あい\nうえ\nお"
    assert one(spark, text.wrap(F.col("s"), 2), s="") == ""
    assert [one(spark, text.utf8_complete(F.unhex("s")), s=h) for h in ("E38182", "E3", "")] == [True, False, True]
    assert one(spark, text.number(F.expr("try_cast(s as double)"), 1, "%"), s="x1") == "-"
    assert one(spark, text.machine_label(F.col("c"), F.col("r"), F.col("m")), c="Apple M2 Ultra", r=128, m="Mac14,14") == "Apple M2 Ultra 128GB (Mac14,14)"


def test_wrap_keeps_every_character(spark):
    rng = random.Random(1)
    for _ in range(20):
        s = "".join(rng.choice("aあ漢😀 ") for _ in range(rng.randint(0, 60)))
        assert one(spark, text.wrap(F.col("s"), 7), s=s).replace("\n", "") == s


@pytest.mark.parametrize("v", [6395.5, -175.5, 5323.5, 106.5, 1.005, -0.00001, 2.5, 1e15, float("nan"), None])
def test_printed_numbers_round_by_their_exact_value(spark, v):
    (r,) = spark.createDataFrame([(v,)], "v double").select(text.percent(F.col("v") / 10000).alias("p"), text.number(F.col("v"), 2, " %").alias("n"), text.number(F.col("v")).alias("whole")).collect()
    assert tuple(r) == (("-",) * 3 if v is None else (f"{v / 10000 * 100.0:.2f}%", f"{v:.2f} %", f"{v:.0f}"))
