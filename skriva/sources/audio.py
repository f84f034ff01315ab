"""PCM audio of any width, channels and rate, and copies at one rate.

Sources are read as WAV of 8, 16, 24 or 32 bits; channels are averaged.  Rates are
changed by a polyphase filter that takes samples block by block, so what it holds does
not grow with the file, and gives the same for any blocks.  ``copies`` keeps results
under a key of content and rate: what is there is looked up and not made again.

Cases: what cannot be read is a row with an error; a file without samples has no blocks;
files of equal content share a copy.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.signal import SAMPLE_RATE

#: Zero crossings of the filter on either side.
CROSSINGS = 16
BLOCK_S = 10.0


class Resampler:
    """Samples at one rate in, samples at another out: y[m] is the windowed sinc sum around input place m * in / out.

    The filter is a sinc under a Hann window, as wide as CROSSINGS of the lower rate, kept as one row of weights a
    phase.  Before the first and behind the last sample there is silence; n samples give ceil(n * out / in).
    """

    def __init__(self, rate_in: int, rate_out: int):
        if rate_in < 1 or rate_out < 1:
            raise ValueError(f"rates {rate_in} and {rate_out}")
        g = gcd(rate_in, rate_out)
        self.up, self.down = rate_out // g, rate_in // g
        wide = max(self.up, self.down)
        self.half = ceil(CROSSINGS * wide / self.up)
        t = np.arange(self.up)[:, None] - np.arange(-self.half, self.half + 1)[None, :] * self.up
        shape = np.where(np.abs(t) <= CROSSINGS * wide, 0.5 + 0.5 * np.cos(np.pi * t / (CROSSINGS * wide)), 0.0)
        self.weights = self.up / wide * np.sinc(t / wide) * shape
        self._held, self._from, self._seen, self._made = np.zeros(self.half), -self.half, 0, 0

    def _upto(self, m: int) -> np.ndarray:
        """Outputs up to number m, whose inputs are held."""
        if m <= self._made:
            return np.zeros(0)
        place = np.arange(self._made, m) * self.down
        windows = np.lib.stride_tricks.sliding_window_view(self._held, 2 * self.half + 1)
        out = np.empty(len(place))
        for a in range(0, len(place), 65_536):
            b = place[a : a + 65_536]
            out[a : a + 65_536] = np.einsum("ij,ij->i", windows[b // self.up - self.half - self._from], self.weights[b % self.up])
        self._made = m
        keep = m * self.down // self.up - self.half
        self._held, self._from = self._held[keep - self._from :], keep
        return out

    def feed(self, samples: np.ndarray) -> np.ndarray:
        self._held = np.concatenate((self._held, np.asarray(samples, np.float64)))
        self._seen += len(samples)
        # the last output whose right side is known
        return self._upto(max(((self._seen - self.half) * self.up - 1) // self.down + 1, 0) if self._seen > self.half else 0)

    def end(self) -> np.ndarray:
        self._held = np.concatenate((self._held, np.zeros(self.half + 1)))
        return self._upto(-(-self._seen * self.up // self.down))


def pcm_blocks(content: bytes, frames: int = 1 << 18) -> tuple[int, Iterator[np.ndarray]]:
    """(sample rate, blocks of mono samples in -1..1) of a WAV file."""
    w = wave.open(io.BytesIO(content))
    width, channels = w.getsampwidth(), w.getnchannels()
    if width not in (1, 2, 3, 4):
        raise ValueError(f"{8 * width} bits a sample")

    def blocks() -> Iterator[np.ndarray]:
        while raw := w.readframes(frames):
            raw = raw[: len(raw) // (width * channels) * width * channels]
            if width == 1:  # without a sign
                x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
            elif width == 3:
                b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
            else:
                x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << 8 * width - 1)
            yield x.reshape(-1, channels).mean(axis=1)

    return w.getframerate(), blocks()


BLOCKS = "path string, block int, samples array<float>, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def _rows(path: str, content: bytes, rate: int, size: int) -> Iterator[tuple]:
    held, k = np.zeros(0), 0
    try:
        own, blocks = pcm_blocks(content)
        resampler = Resampler(own, rate)
        for part in (resampler.feed(x) for x in blocks):
            held = np.concatenate((held, part))
            while len(held) >= size:
                yield path, k, held[:size].astype(np.float32), None
                held, k = held[size:], k + 1
        held = np.concatenate((held, resampler.end()))
        for a in range(0, len(held), size):
            yield path, k + a // size, held[a : a + size].astype(np.float32), None
    except Exception as e:  # noqa: BLE001  a broken file is a row with an error
        yield path, None, None, str(e) or repr(e)


def audio_blocks(files: DataFrame, rate: int = SAMPLE_RATE, block_s: float = BLOCK_S, content: str = "content", path: str = "path") -> DataFrame:
    """(path, block, samples, error): files as consecutive blocks at one rate; see ``chunking.energy_chunk_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _rows(p, raw.as_py() or b"", rate, max(1, int(block_s * rate))):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, BLOCKS)


def copy_key(content: Column, rate: int) -> Column:
    return F.concat_ws("-", F.sha2(content, 256), F.lit(str(rate)))


def copies(files: DataFrame, folder: str, rate: int = SAMPLE_RATE, block_s: float = BLOCK_S) -> DataFrame:
    """``audio_blocks`` of (path, content), by copies in ``folder``; a content that has one there is not read again."""
    spark = files.sparkSession
    keyed = files.select("path", "content", copy_key(F.col("content"), rate).alias("key"))
    try:
        there = spark.read.parquet(folder)
        new = keyed.join(there.select("key").distinct(), "key", "left_anti")
    except AnalysisException:  # no copies yet
        new = keyed
    made = audio_blocks(new.select(F.col("key").alias("path"), "content").dropDuplicates(["path"]), rate, block_s)
    made.withColumnRenamed("path", "key").write.mode("append").parquet(folder)
    return keyed.select("path", "key").join(spark.read.parquet(folder), "key").select("path", "block", "samples", "error")


def resample_rows(blocks: DataFrame, by: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """(by, block, samples) at another rate: files given as rows of consecutive samples, each read once in order."""
    kind = blocks.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, resampler, n = None, None, 0

        def row(x: np.ndarray, own: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], own), pa.array([n], pa.int32()), pa.array([x], pa.list_(pa.float64()))], [by, "block", "samples"])

        own = pa.null()
        for batch in batches:
            own = batch.schema[0].type
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if resampler is None or key != file:
                    if resampler is not None:
                        yield row(resampler.end(), own)
                    file, resampler, n = key, Resampler(rate_in, rate_out), 0
                x = resampler.feed(block.values.to_numpy(zero_copy_only=False) if block.is_valid else np.zeros(0))
                if len(x):
                    yield row(x, own)
                    n += 1
        if resampler is not None:
            yield row(resampler.end(), own)

    rows = blocks.select(by, order, samples).repartition(by).sortWithinPartitions(by, order).drop(order)
    return rows.mapInArrow(run, f"{by} {kind}, block int, samples array<double>")
