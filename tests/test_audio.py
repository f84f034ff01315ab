"""Audio: widths and channels, resampling against the direct sum, copies made once."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.operators import chunking
from skriva.sources import audio


def wav(samples, rate, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        top = (1 << 8 * width - 1) - 1
        for x in samples:
            v = int(round(x * top))
            w.writeframes(bytes([v + 128]) if width == 1 else struct.pack("<i", v << 8 if width == 3 else v)[1:] if width == 3 else struct.pack("<h" if width == 2 else "<i", v))
    return out.getvalue()


def direct(x, rate_in, rate_out):
    """Every output as the sum over all inputs."""
    lower = min(rate_in, rate_out)
    out = []
    for m in range(-(-len(x) * rate_out // rate_in)):
        t = m / rate_out - np.arange(len(x)) / rate_in  # seconds
        u = t * lower
        w = np.where(np.abs(u) <= audio.CROSSINGS, 0.5 + 0.5 * np.cos(np.pi * u / audio.CROSSINGS), 0)
        out.append(float((x * np.sinc(u) * w).sum() * lower / rate_in))
    return np.array(out)


@pytest.mark.parametrize("rate_in,rate_out", [(44100, 16000), (8000, 16000), (16000, 16000), (48000, 16000), (11025, 16000)])
def test_resampling_is_the_direct_sum_for_any_blocks(rate_in, rate_out):
    rng = np.random.default_rng(1)
    x = rng.normal(size=700)
    want = direct(x, rate_in, rate_out)
    for size in (1, 37, 700):
        r = audio.Resampler(rate_in, rate_out)
        got = np.concatenate([*(r.feed(x[k : k + size]) for k in range(0, len(x), size)), r.end()])
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-9
    r = audio.Resampler(rate_in, rate_out)
    assert len(r.feed(np.zeros(0))) + len(r.end()) == 0


@pytest.mark.parametrize("rate", [8000, 22050, 48000])
def test_a_tone_keeps_its_pitch(rate):
    t = np.arange(rate) / rate
    r = audio.Resampler(rate, 16000)
    got = np.concatenate((r.feed(np.sin(2 * np.pi * 440 * t)), r.end()))
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16000)
    assert np.abs(got - want)[500:-500].max() < 0.01


def test_a_resampler_holds_little():
    r = audio.Resampler(44100, 16000)
    most = 0
    for _ in range(300):
        r.feed(np.ones(1000))
        most = max(most, len(r._held))
    assert most < 2500


def test_widths_channels_and_copies(spark, tmp_path):
    x = np.sin(np.arange(4000) / 9)
    stereo = np.repeat(x, 2)
    files = [("w8", wav(x, 16000, 1)), ("w16", wav(x, 16000)), ("w24", wav(x, 16000, 3)), ("w32", wav(x, 16000, 4)), ("stereo", wav(stereo, 16000, 2, 2)), ("same", wav(x, 16000)), ("slow", wav(x[::2], 8000)), ("bad", b"no audio"), ("none", None), ("empty", wav([], 16000))]
    frame = spark.createDataFrame(files, "path string, content binary")
    rows = audio.audio_blocks(frame, block_s=0.1).collect()
    line = lambda p: np.concatenate([r.samples for r in sorted((r for r in rows if r.path == p and not r.error), key=lambda r: r.block)] or [np.zeros(0)])
    for p, off in (("w8", 0.02), ("w16", 1e-3), ("w24", 1e-5), ("w32", 1e-5), ("stereo", 1e-3)):
        assert len(line(p)) == 4000 and np.abs(line(p) - x).max() < off
    assert len(line("slow")) == 4000 and np.abs(line("slow") - x)[100:-100].max() < 0.02
    assert {r.path for r in rows if r.error} == {"bad", "none"} and not any(r.path == "empty" for r in rows)
    assert all(len(r.samples) <= 1600 for r in rows if not r.error)
    folder = str(tmp_path / "copies")
    first = audio.copies(frame.where("path in ('w16', 'same', 'bad')"), folder, block_s=0.1)
    assert first.where("path = 'w16'").count() == first.where("path = 'same'").count() == 3
    before = spark.read.parquet(folder).count()
    assert before == 4  # one copy of equal contents, and the error
    again = audio.copies(frame.where("path in ('w16', 'w24')"), folder, block_s=0.1)
    assert again.count() == 6 and spark.read.parquet(folder).count() == before + 3
    chunks = chunking.energy_chunk_rows(audio.audio_blocks(frame.where("path = 'w16'"), block_s=0.01), "path", "block", target_s=0.1, search_s=0.02).collect()
    assert max(r.end_sample for r in chunks) == 4000 and len(chunks) >= 2


def test_rows_of_blocks(spark):
    rng = np.random.default_rng(2)
    files = {"a": rng.normal(size=500), None: rng.normal(size=90)}
    rows = [(f, k, x[k : k + 40].tolist()) for f, x in files.items() for k in range(0, len(x), 40)] + [("a", 10**6, None)]
    blocks = spark.createDataFrame(rows, "file string, place int, samples array<double>").repartition(3)
    got = audio.resample_rows(blocks, "file", "place", "samples", 400, 160).collect()
    for f, x in files.items():
        line = np.concatenate([r.samples for r in sorted((r for r in got if r.file == f), key=lambda r: r.block)])
        assert np.abs(line - direct(x, 400, 160)).max() < 1e-9
    assert audio.resample_rows(blocks.where(F.lit(False)), "file", "place", "samples", 400, 160).count() == 0
