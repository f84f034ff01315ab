"""Reference data and how names resolve against it: engines, languages, machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skriva.functions import text

#: Code and English name of each language that the name-taking engine knows.
LANGUAGES = {
    "zh": "Chinese", "en": "English", "yue": "Cantonese", "ar": "Arabic", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "id": "Indonesian", "it": "Italian",
    "ko": "Korean", "ru": "Russian", "th": "Thai", "vi": "Vietnamese", "ja": "Japanese", "tr": "Turkish", "hi": "Hindi", "ms": "Malay", "nl": "Dutch", "sv": "Swedish",
    "da": "Danish", "fi": "Finnish", "pl": "Polish", "cs": "Czech", "fil": "Filipino", "fa": "Persian", "el": "Greek", "hu": "Hungarian", "mk": "Macedonian", "ro": "Romanian",
}
#: Three-letter codes of the same languages.
THREE = {
    "zho": "zh", "chi": "zh", "eng": "en", "ara": "ar", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ind": "id", "ita": "it", "kor": "ko", "rus": "ru", "tha": "th", "vie": "vi",
    "jpn": "ja", "tur": "tr", "hin": "hi", "msa": "ms", "may": "ms", "nld": "nl", "dut": "nl", "swe": "sv", "dan": "da", "fin": "fi", "pol": "pl", "ces": "cs", "cze": "cs", "fas": "fa", "per": "fa", "ell": "el",
    "gre": "el", "hun": "hu", "mkd": "mk", "mac": "mk", "ron": "ro", "rum": "ro",
}
#: Measured decode settings by chip name and memory; batch sizes that measured well.
PROFILES = [("Apple M4", 16, 16, 16, 60.0, 8), ("Apple M2 Ultra", 96, 192, 16, 60.0, 8)]
BATCHES = (1, 12, 16, 24, 32, 64, 128)
#: Family, size, repository, engine, whether it is its family's default.
MODELS = [
    ("voxtral", "", "mlx-community/Voxtral-Mini-4B-Realtime-2602-4bit", "voxtral", True),
    ("whisper", "tiny", "mlx-community/whisper-tiny-mlx", "mlx-whisper", False),
    ("whisper", "base", "mlx-community/whisper-base-mlx", "mlx-whisper", False),
    ("whisper", "small", "mlx-community/whisper-small-mlx", "mlx-whisper", False),
    ("whisper", "medium", "mlx-community/whisper-medium-mlx", "mlx-whisper", False),
    ("whisper", "large-v2", "mlx-community/whisper-large-v2-mlx", "mlx-whisper", False),
    ("whisper", "large-v3", "mlx-community/whisper-large-v3-mlx", "mlx-whisper", False),
    ("whisper", "turbo", "mlx-community/whisper-large-v3-turbo", "mlx-whisper", True),
    ("kotoba", "", "kotoba-tech/kotoba-whisper-v2.0", "mlx-chunked", True),
    ("qwen3-asr", "0.6B", "mlx-community/Qwen3-ASR-0.6B-8bit", "mlx-qwen3", False),
    ("qwen3-asr", "1.7B", "mlx-community/Qwen3-ASR-1.7B-8bit", "mlx-qwen3", True),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "code string, name string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "family string, size string, repo string, backend string, is_default boolean")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "ordinal int, chip_match string, ram_min int, ram_max int, batch int, chunk_seconds double, kv_bits int")


def base_code(value: Column) -> Column:
    """The base subtag of a language tag; null where it names no language of the table."""
    tag = F.lower(F.split_part(F.replace(F.trim(value), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))
    known = F.array(*map(F.lit, LANGUAGES))
    three = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    return F.when(F.array_contains(known, tag), tag).otherwise(three[tag])


def to_iso(value: Column) -> Column:
    """Code by any spelling of a tag, or by English name; null is an unknown language."""
    names = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (v.lower(), k)])
    return F.coalesce(base_code(value), names[F.lower(F.trim(value))])


def to_english_name(value: Column, accepted: tuple[str, ...] = tuple(LANGUAGES.values())) -> Column:
    """The engine's own name, in any case, or by code; null where the engine does not take it."""
    own = F.create_map(*[F.lit(x) for v in accepted for x in (v.lower(), v)])
    by_code = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[base_code(value)]
    return F.coalesce(own[F.lower(F.trim(value))], F.when(by_code.isin(list(accepted)), by_code))


def snap_batch(want: Column) -> Column:
    """The largest good batch size that is not larger."""
    return F.array_max(F.filter(F.array(*map(F.lit, BATCHES)), lambda b: b <= F.greatest(want, F.lit(1))))


def derive_batch(gpu_gb: Column, weights_gb: Column | float, chunk_s: Column | float, cores: Column) -> Column:
    """By memory (half the working set, less weights and overhead) and by cores (3 rows each); never 2 to 11."""
    w, c = (x if isinstance(x, Column) else F.lit(x) for x in (weights_gb, chunk_s))
    rows = F.floor(F.greatest(gpu_gb * 0.5 - w - 0.6, F.lit(0.0)) / (F.lit(0.002) * F.greatest(c, F.lit(1.0)))).cast("int")
    want = F.least(rows, (F.lit(3) * F.coalesce(F.nullif(cores, F.lit(0)), F.lit(16))).cast("int"))
    return F.when(want < 12, 1).otherwise(snap_batch(want))


def resolve_profile(machines: DataFrame, key: str, weights_gb: float = 2.5) -> DataFrame:
    """``machines`` (chip, ram_gb, gpu_cores, gpu_working_set_gb) with batch, chunk_seconds, kv_bits, matched.

    The first profile whose name is part of the chip's and whose memory window holds wins;
    no profile: the settings are derived.
    """
    p = F.broadcast(profiles(machines.sparkSession))
    fits = F.contains(F.lower(F.coalesce("chip", F.lit(""))), F.lower("chip_match")) & F.coalesce("ram_gb", F.lit(0)).between(F.col("ram_min"), F.col("ram_max"))
    found = machines.select(key, "chip", "ram_gb").join(p, fits).groupBy(key).agg(F.min_by(F.struct("batch", "chunk_seconds", "kv_bits"), "ordinal").alias("p"))
    derived = derive_batch(F.coalesce("gpu_working_set_gb", F.lit(10.0)), weights_gb, 60.0, F.col("gpu_cores"))
    return machines.join(found, key, "left").select(
        *machines.columns, F.coalesce("p.batch", derived).alias("batch"), F.coalesce("p.chunk_seconds", F.lit(60.0)).alias("chunk_seconds"), F.coalesce("p.kv_bits", F.lit(8)).alias("kv_bits"),
        F.when(F.col("p").isNull(), "derived").otherwise("profile").alias("matched"),
    )


def resolve_model(asked: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """``asked`` with repo, backend and error.

    A family with or without size, the repository of a listed model, or any repository by
    what its name infers; a size that is not published and a bare word are errors.
    """
    m = models(asked.sparkSession)
    m = F.broadcast(m.select(*(F.col(c).alias(f"_m_{c}") for c in m.columns)))
    family = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("voxtral"))
    want = F.lower(F.trim(F.coalesce(F.col(size), F.lit(""))))
    rows = asked.withColumn("_family", family).withColumn("_want", want)
    fits = (F.col("_family") == F.col("_m_family")) & F.when(F.col("_want") == "", F.col("_m_is_default")).otherwise(F.lower("_m_size") == F.col("_want")) | (F.col("_family") == F.col("_m_repo"))
    found = rows.join(m, fits, "left").select(*asked.columns, "_family", "_want", F.col("_m_repo").alias("_repo"), F.col("_m_backend").alias("_backend"))
    is_family = F.col("_family").isin(sorted({x[0] for x in MODELS}))
    raw = ~is_family & F.contains("_family", F.lit("/"))
    error = F.when(F.col("_repo").isNotNull() | raw, None).when(is_family, F.concat(F.lit("unknown size "), F.col("_want"))).otherwise(F.concat(F.lit("unknown model "), F.col("_family")))
    return found.select(*asked.columns, F.coalesce("_repo", F.when(raw, F.col("_family"))).alias("repo"), F.coalesce("_backend", F.when(raw, text.infer_backend(F.col("_family")))).alias("backend"), error.alias("error"))


def fastest_safe(rows: DataFrame, by: str, batch: str, speed: str, peak_gb: str, limit_gb: str, share: float = 0.6) -> DataFrame:
    """(by, batch): the fastest that stays under its share of memory; if none does, the fastest."""
    safe = F.col(peak_gb) <= share * F.col(limit_gb)
    best = Window.partitionBy(by).orderBy(F.when(safe, 0).otherwise(1), F.desc(speed), batch)
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def needs_language(backend: Column) -> Column:
    return backend.isin("mlx-whisper", "mlx-chunked", "mlx-qwen3")


def chunked_long_form(backend: Column) -> Column:
    return backend.isin("mlx-chunked", "mlx-qwen3")
