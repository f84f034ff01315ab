"""Readers: text and subtitle files, corpus pairs, run documents, PCM audio.

All of them read through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skriva.functions import text

AUDIO = ("wav", "mp3", "m4a", "mp4", "flac", "ogg")
#: References by suffix, the first that exists wins; for timing only those with times.
REFERENCES = ("_transcript.txt", ".srt", ".txt")
TIMED_REFERENCES = (".srt", ".vtt")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name): file names without their content."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def pair_files(files: DataFrame, references: tuple[str, ...] = REFERENCES, name: str = "name") -> DataFrame:
    """(stem, audio, reference): audio with its reference of highest precedence; audio without one is left out."""
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    stem = lambda c, n: F.substring(c, 1, F.length(c) - n)
    audio = files.where(suffix.isin(*AUDIO)).select(F.expr(f"substring({name}, 1, length({name}) - length(element_at(split({name}, '[.]'), -1)) - 1)").alias("stem"), F.col(name).alias("audio"))
    candidates = [files.where(F.endswith(name, F.lit(s))).select(stem(F.col(name), len(s)).alias("stem"), F.col(name).alias("reference"), F.lit(k).alias("rank")) for k, s in enumerate(references)]
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    best = every.groupBy("stem").agg(F.min_by("reference", "rank").alias("reference"))
    return audio.join(best, "stem").select("stem", "audio", "reference")


_TIME = r"(?:(\d{2}):)?(\d{2}):(\d{2})[,.](\d{3})"
CUE = rf"(?m)^[ \t]*{_TIME}\s*-->\s*{_TIME}[^\n]*\n((?:(?!\n[ \t]*\n)[\s\S])*)"


def _seconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))
    return n(h) * 3600 + n(m) * 60 + n(s) + n(ms) / 1000.0


def parse_cues(files: DataFrame, by: str = "path", raw: str = "raw") -> DataFrame:
    """(by, cue_idx, start_s, end_s, text) of SRT and VTT texts; a text runs to a blank line or the end."""
    clean = F.replace(F.col(raw), F.lit("\r\n"), F.lit("\n"))
    rows = files.select(by, F.posexplode(F.regexp_extract_all(clean, F.lit(CUE), F.lit(0))).alias("cue_idx", "_c"))
    g = lambda k: F.regexp_extract("_c", CUE, k)
    return rows.select(by, "cue_idx", _seconds(g(1), g(2), g(3), g(4)).alias("start_s"), _seconds(g(5), g(6), g(7), g(8)).alias("end_s"), F.rtrim(g(9), F.lit("\n")).alias("text"))


def references(files: DataFrame) -> DataFrame:
    """(path, text): references as they are scored; subtitles of both kinds lose their frame."""
    plain = files.where(~F.endswith("path", F.lit(".vtt"))).select("path", text.reference_text(F.col("path"), F.col("raw")).alias("text"))
    joined = parse_cues(files.where(F.endswith("path", F.lit(".vtt")))).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return plain.unionByName(joined)


def line_times(cues: DataFrame, by: str = "path") -> DataFrame:
    """(by, line, start_s): the start time of every text line."""
    rows = cues.select(by, "cue_idx", "start_s", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("i", "text"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy(by).orderBy("cue_idx", "i")) - 1).select(by, "line", "start_s", "text")


RESULT = "file string, error string, duration_s double, wall_s double, unit string, ref_chars long, hyp_chars long, extra_ratio double, coverage double, cer double, coverage_cer double, x_realtime double, text string"
RUN = f"label string, engine string, complete boolean, files_scored long, files_expected long, aggregate struct<char:double,word:double>, ref_units struct<char:long,word:long>, x_realtime double, results array<struct<{', '.join(p.replace(' ', ':', 1) for p in RESULT.split(', ')).replace(' ', '')}>>"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents, one JSON a file."""
    return spark.read.schema(RUN).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def run_results(documents: DataFrame, incomplete: str = "drop", duplicates: str = "first") -> DataFrame:
    """Result rows keyed by (label, dur, unit): rows with errors or without duration go.

    ``incomplete``: keep or drop runs that say they are not complete, or fail on them.
    ``duplicates``: which of several rows of a key stays, first or last.
    """
    if incomplete not in ("keep", "drop", "fail") or duplicates not in ("first", "last"):
        raise ValueError(f"incomplete={incomplete!r}, duplicates={duplicates!r}")
    whole = F.coalesce("complete", F.lit(True))
    rows = documents if incomplete == "keep" else documents.where(whole) if incomplete == "drop" else documents.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("incomplete run "), "label")).cast("boolean")))
    each = rows.select("label", F.posexplode("results").alias("place", "r")).select("label", "place", "r.*").where("error is null and duration_s is not null")
    each = each.withColumn("dur", F.bround("duration_s").cast("bigint"))
    order = F.col("place") if duplicates == "first" else F.desc("place")
    return each.withColumn("_n", F.row_number().over(Window.partitionBy("label", "dur", "unit").orderBy(order))).where("_n = 1").drop("_n")


def prompt_variants(lines: DataFrame, value: str = "value", place: str = "place") -> DataFrame:
    """(label, prompt) of ``label<TAB>text`` lines: others are skipped, of equal labels the last holds, and `none` is always there."""
    parts = F.split(value, "\t", 2)
    rows = lines.where(F.contains(value, F.lit("\t"))).select(F.trim(parts[0]).alias("label"), parts[1].alias("prompt"), place)
    held = rows.groupBy("label").agg(F.max_by("prompt", place).alias("prompt")).where("label <> 'none'")
    none = lines.sparkSession.createDataFrame([("none", "")], "label string, prompt string")
    return none.unionByName(held)


def hypotheses(files: DataFrame, stems: DataFrame, name: str = "name") -> DataFrame:
    """(name, stem, label) of <stem>.<label>.txt whose stem is known."""
    pattern = r"^(.+?)\.([^.]+(?:\.[^.]+)*)\.txt$"
    rows = files.select(F.col(name).alias("name"), F.regexp_extract(name, pattern, 1).alias("stem"), F.regexp_extract(name, pattern, 2).alias("label"))
    return rows.where("stem <> ''").join(stems.select("stem").distinct(), "stem", "left_semi")


PCM = T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


@F.pandas_udf(PCM)
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """16-bit mono PCM; anything else is an error row, not a failure."""
    rows = []
    for raw in content:
        try:
            with wave.open(io.BytesIO(raw)) as w:
                if w.getnchannels() != 1 or w.getsampwidth() != 2:
                    raise ValueError(f"{w.getnchannels()} channels of {8 * w.getsampwidth()} bits; 16-bit mono is read")
                rows.append((w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768, None))
        except Exception as e:  # noqa: BLE001  a broken file is a row with an error
            rows.append((None, None, str(e) or repr(e)))
    return pd.DataFrame({"sample_rate": pd.array([r[0] for r in rows], "Int32"), "samples": [r[1] for r in rows], "error": [r[2] for r in rows]})


def audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, samples, error); containers other than WAV need a decoder that is not here."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_wav("content").alias("a")).select("path", "a.*")
