"""The model seam: chunks of audio go in, timed tokens come out.

A model is a class with ``decode(samples, sample_rate) -> [(piece, seconds), ...]``.  One
instance lives in each Python worker; Arrow batches of chunks are its batches.  Weights
are not part of this library, and ``Levels`` is a deterministic stand-in for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import runaway
from skriva.operators.cues import TOKEN_S

TOKENS = "file_id string, chunk_idx int, pos int, bytes binary, t_s double"


class Levels:
    """One token for each 80 ms: a letter by the level of that stretch."""

    def decode(self, samples: np.ndarray, rate: int) -> list[tuple[bytes, float]]:
        step = int(TOKEN_S * rate)
        n = len(samples) // step
        rms = np.sqrt((np.asarray(samples[: n * step], np.float64).reshape(n, step) ** 2).mean(1)) if n else []
        return [(b"" if r < 1e-3 else bytes([97 + min(25, int(r * 26))]), (k + 1) * TOKEN_S) for k, r in enumerate(rms)]


def token_budget(seconds: Column, least: int = 256, rate: int = 25) -> Column:
    return F.greatest(F.lit(least), F.floor(seconds * rate).cast("int"))


def transcribe(chunks: DataFrame, make: Callable[[], object] = Levels) -> DataFrame:
    """(file_id, chunk_idx, pos, bytes, t_s) of chunks (file_id, chunk_idx, samples, sample_rate, warmup_tokens).

    Tokens of the warm-up are dropped and times count from the kept part; a window's budget
    follows its own length, so one that runs away costs no other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                spared = r.warmup_tokens * TOKEN_S
                budget = max(256, int(25 * len(r.samples) / r.sample_rate))
                kept = [(b, t - spared) for b, t in model.decode(np.asarray(r.samples), r.sample_rate)[:budget] if t > spared + 1e-9]
                rows += [(r.file_id, r.chunk_idx, k, b, t) for k, (b, t) in enumerate(kept) if b]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_idx", "pos", "bytes", "t_s"])

    return chunks.select(F.col("file_id").cast("string"), "chunk_idx", "samples", "sample_rate", "warmup_tokens").mapInPandas(run, TOKENS)


def health(windows: DataFrame, by: str, text: str, seconds: str, end: str) -> DataFrame:
    """(by, windows, empty, runaways, truncated): signs of a decode that went wrong."""
    late = F.max(end) / F.nullif(F.sum(seconds), F.lit(0.0))
    return windows.groupBy(by).agg(F.count("*").alias("windows"), F.count_if(F.col(text) == "").alias("empty"), F.count_if(runaway(F.col(text), F.col(seconds))).alias("runaways"), (late < 0.99).alias("truncated"))
