"""Text expressions for transcripts.

Everything is a JVM expression except ``nfkc`` and ``fixed``, for which Spark has no builtin (Arrow
batch functions).  Regular expressions use (?U), so classes are Unicode's.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What scoring treats as punctuation.
MARKS = "、。，．,.!?！？…・「」『』（）()\\[\\]〈〉《》：:;；\\-~〜?"
_DROP = f"(?U)[\\s{MARKS}]+"
_SPACE_OUT = f'[{MARKS}"]+'
#: A line that only names a speaker; a timing line of a subtitle file; a word.
SPEAKER = r"(?U)^\s*[A-Za-z][A-Za-z0-9_ .'-]{0,30}:\s*$"
TIMING = r"^\d{2}:\d{2}:\d{2},\d{3} --> \d{2}:\d{2}:\d{2},\d{3}"
WORD = r"(?U)[^\W_]+(?:'[^\W_]+)?"
CJK = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(s: Column) -> Column:
    """Compatibility composition; texts of ASCII alone are that already and do not leave the JVM."""
    return F.coalesce(_nfkc(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)


def drop_marks(s: Column) -> Column:
    """Without punctuation and white space; the case and the long-vowel mark stay."""
    return F.regexp_replace(s, _DROP, "")


def normalize_chars(s: Column) -> Column:
    return drop_marks(nfkc(s))


def space_marks(s: Column) -> Column:
    """Punctuation as one space, trimmed, lower case."""
    one = F.regexp_replace(F.regexp_replace(s, _SPACE_OUT, " "), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(one, r"(?U)^\s+|\s+$", ""))


def normalize_words(s: Column) -> Column:
    return space_marks(nfkc(s))


def words(s: Column) -> Column:
    """Words of normalised text: letters and digits with an apostrophe inside."""
    return F.regexp_extract_all(s, F.lit(WORD), F.lit(0))


def tokenize(s: Column) -> Column:
    return words(normalize_words(s))


def characters(s: Column) -> Column:
    """Code points as an array; none for an empty text."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def cjk_share(s: Column, sample: int = 4000) -> Column:
    head = F.substring(s, 1, sample)
    return (F.length(head) - F.length(F.regexp_replace(head, CJK, ""))) / F.nullif(F.length(head), F.lit(0))


def is_space_delimited(s: Column, threshold: float = 0.15) -> Column:
    """By the first 4000 code points; an empty text is not."""
    return F.coalesce(cjk_share(s) < threshold, F.lit(False))


def unit_of(s: Column) -> Column:
    return F.when(is_space_delimited(s), F.lit("word")).otherwise(F.lit("char"))


def script_of(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^[\x{3040}-\x{309F}]"), "hira").when(c.rlike(r"^[\x{30A0}-\x{30FF}]"), "kata")
        .when(c.rlike(r"^[\x{4E00}-\x{9FFF}]"), "kanji").when(c.rlike(r"(?U)^\d"), "digit").otherwise("other")
    )


def plain_error_rate(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over code points, relative to the reference."""
    return F.levenshtein(ref, hyp) / F.greatest(F.length(ref), F.lit(1))


def timestamp(seconds: Column, sep: str = ",") -> Column:
    """HH:MM:SS,mmm with half-even milliseconds; hours are not bounded."""
    ms = F.bround(seconds * 1000.0).cast("bigint")
    part = lambda unit, modulus: (F.floor(ms / unit) % modulus).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(ms / 3600000).cast("bigint"), part(60000, 60), part(1000, 60), (ms % 1000).cast("bigint"))


def wrap(s: Column, width: int = 16) -> Column:
    """Fixed-width lines of code points."""
    n = F.ceil(F.length(s) / width).cast("int")
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(s, i * width + 1, F.lit(width)))
    return F.when(n > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def utf8_complete(b: Column) -> Column:
    """Whether bytes end on a character boundary; no bytes do."""
    return F.is_valid_utf8(b.cast("string"))


def occurrences(s: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term; 0 for an empty term."""
    return F.when(F.length(term) > 0, ((F.length(s) - F.length(F.replace(s, term, F.lit("")))) / F.length(term)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def replacement_chars(s: Column) -> Column:
    return occurrences(s, F.lit("�"))


def subtitle_text(raw: Column) -> Column:
    """Text lines of an SRT file: no blank, all-digit or timing lines; joined by newlines."""
    lines = F.transform(F.split(raw, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"(?U)^\d+$") & ~x.rlike(TIMING)), "\n")


def reference_text(path: Column, raw: Column) -> Column:
    """A reference by its suffix: subtitles lose their frame, transcripts their speaker lines."""
    plain = F.array_join(F.filter(F.split(raw, "\n"), lambda x: ~x.rlike(r"(?U)^\s*$") & ~x.rlike(SPEAKER)), "\n")
    return F.when(path.endswith(".srt"), subtitle_text(raw)).otherwise(plain)


def fixed(v: Column, digits: int) -> Column:
    """A number to so many decimals by its exact value, halves to even; the JVM's formats round what is printed of it, halves up."""

    @F.pandas_udf(T.StringType())
    def said(x: pd.Series) -> pd.Series:
        return x.map(lambda n: f"{n:.{digits}f}")

    return said(v.cast("double"))


def number(v: Column, digits: int = 0, suffix: str = "") -> Column:
    """A value to print; nothing known is a dash."""
    return F.when(v.isNull(), "-").otherwise(F.concat(fixed(v, digits), F.lit(suffix)))


def percent(v: Column, digits: int = 2) -> Column:
    return F.when(v.isNull(), "-").otherwise(F.concat(fixed(v * 100.0, digits), F.lit("%")))


def chip_family(chip: Column) -> Column:
    """The first of M1 to M5 that the name holds."""
    up, out = F.upper(F.coalesce(chip, F.lit(""))), F.lit("unknown")
    for g in ("M5", "M4", "M3", "M2", "M1"):
        out = F.when(up.contains(g), g).otherwise(out)
    return out


def machine_label(chip: Column, ram_gb: Column, model: Column) -> Column:
    name = F.coalesce(chip, F.lit("unknown chip"))
    ram = F.when(ram_gb > 0, F.concat(F.lit(" "), ram_gb.cast("string"), F.lit("GB"))).otherwise("")
    return F.concat(name, ram, F.when(F.length(model) > 0, F.concat(F.lit(" ("), model, F.lit(")"))).otherwise(""))


def infer_backend(repo: Column) -> Column:
    """An engine by what a repository is called; architectures come before general words."""
    low = F.lower(repo)
    has = lambda *names: low.rlike("|".join(names))
    return (
        F.when(has("voxtral"), "voxtral").when(has("qwen3[-_]asr"), "mlx-qwen3").when(has("kotoba", "distil"), "mlx-chunked")
        .when(has("whisper"), "mlx-whisper").otherwise("voxtral")
    )


def precision_key(asked: Column, published: Column) -> Column:
    """A precision by its key in ``published``: every spelling of full precision is the full build."""
    key = F.lower(F.trim(asked))
    full = F.when(F.array_contains(published, "bf16"), "bf16").when(F.array_contains(published, "fp16"), "fp16").otherwise(key)
    return F.when(key.isin("none", "full", "fp16", "f16", "bf16"), full).otherwise(key)


def precision_order(key: Column) -> Column:
    """Bit counts ascending, whatever else last."""
    return F.coalesce(F.nullif(F.regexp_extract(key, r"^(\d+)bit$", 1), F.lit("")).cast("int"), F.lit(99))


def size_hint(name: Column, family: Column, sizes: Column) -> Column:
    """What an old family-size name is called now; empty where it is none."""
    tail = F.substr(name, F.length(family) + 2)
    found = F.element_at(F.filter(sizes, lambda s: (F.lower(s) == F.lower(tail)) | ((tail == "small") & (s == "0.6B"))), 1)
    hint = (
        F.when(F.size(sizes) == 0, F.concat(F.lit("--model "), family))
        .when(F.size(F.filter(sizes, lambda s: (F.lower(s) == F.lower(tail)) | ((tail == "small") & (s == "0.6B")))) > 0, F.concat(F.lit("--model "), family, F.lit(" --size "), found))
        .otherwise(F.concat(F.lit("--model "), family, F.lit(" --size <one of: "), F.array_join(sizes, ", "), F.lit(">")))
    )
    return F.when(F.startswith(name, F.concat(family, F.lit("-"))), hint).otherwise("")


def runaway(text: Column, seconds: Column, most: float = 25.0) -> Column:
    """More characters a second than speech has."""
    return (seconds > 0) & (F.length(text) / seconds > most)


def busy_reasons(load: Column, cpus: Column, gpu_gb: Column, swapouts: Column, on_battery: Column, low_power: Column) -> Column:
    """Why a host is no place to measure on."""
    found = F.array(
        F.when(load / cpus > 0.35, "load"), F.when(gpu_gb > 3.0, "gpu memory"), F.when(swapouts > 200, "swapping"),
        F.when(on_battery, "battery"), F.when(low_power, "low power mode"),
    )
    return F.filter(found, lambda r: r.isNotNull())


def rewrite(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after the other; the order matters."""
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s
