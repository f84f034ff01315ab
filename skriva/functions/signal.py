"""Level arithmetic on arrays of samples, as column expressions that stay in the JVM.

A null or empty array has no level: peak and frame levels are null or empty, gains 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file is left alone above the trigger; boosts end at the target.
AUTO_TRIGGER_DBFS, AUTO_TARGET_DBFS = -6.0, -1.0
SAMPLE_RATE, TOKEN_SAMPLES = 16000, 1280


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _db(x: Column, floor: float) -> Column:
    return F.when(x.isNotNull(), 20.0 * F.log10(F.greatest(x.cast("double"), F.lit(floor))))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda v: F.abs(v.cast("double"))))


def peak_dbfs(samples: Column) -> Column:
    return _db(peak(samples), 1e-12)


def _mean_square(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return total / F.nullif(F.size(samples).cast("double"), F.lit(0.0))


def frames(samples: Column, frame: int = TOKEN_SAMPLES) -> Column:
    """Whole frames; what is left at the end is not one."""
    n = F.floor(F.size(samples) / frame).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * frame + 1, frame))).otherwise(F.array().cast("array<array<double>>"))


def frame_db(samples: Column, frame: int = TOKEN_SAMPLES) -> Column:
    """Root mean square level of each frame."""
    return F.transform(frames(samples, frame), lambda f: _db(F.sqrt(_mean_square(f)), 1e-10))


def auto_gain_db(samples: Column, trigger: float = AUTO_TRIGGER_DBFS, target: float = AUTO_TARGET_DBFS) -> Column:
    level = peak_dbfs(samples)
    return F.when(level < trigger, target - level).otherwise(0.0)


def chunk_gain_db(samples: Column, target: float = AUTO_TARGET_DBFS, most: float = 20.0, floor: float = -50.0) -> Column:
    level = peak_dbfs(samples)
    return F.when((level > floor) & (level < target), F.least(target - level, F.lit(most))).otherwise(0.0)


def scaled(samples: Column, factor: Column) -> Column:
    """Samples times a factor, clipped to [-1, 1]."""
    return let(factor, lambda g: F.transform(samples, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double") * g))))


def db_factor(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(db)) / 20.0)


def linear_percentile(values: Column, q: float) -> Column:
    """Interpolated percentile (0 to 1) of an array."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.try_element_at(s, lo + 1), F.try_element_at(s, hi + 1)
        return a + (b - a) * (at - lo)

    return let(F.array_sort(values), of)


def active_rms(samples: Column, frame: int = TOKEN_SAMPLES) -> Column:
    """Root mean square of the frames above the 60th percentile of frame level; null without any."""
    zipped = F.arrays_zip(frames(samples, frame).alias("f"), frame_db(samples, frame).alias("d"))
    loud = let(linear_percentile(frame_db(samples, frame), 0.6), lambda p: F.filter(zipped, lambda z: z["d"] > p))
    return F.sqrt(_mean_square(F.flatten(F.transform(loud, lambda z: z["f"]))))


def apply_gain(samples: Column, mode: str = "0", peak_target: float = -1.0, rms_target: float = -23.0, frame: int = TOKEN_SAMPLES) -> Column:
    """Modes: none, auto, peak, rms, or a number of dB.  Where a mode has nothing to go by, the samples stay."""
    same = F.transform(samples, lambda v: v.cast("double"))
    if mode in ("", "none"):
        return same
    if mode == "auto":
        g = auto_gain_db(samples)
        return F.when(g == 0.0, same).otherwise(scaled(samples, db_factor(g)))
    if mode == "peak":
        return F.when(peak(samples) > 0, scaled(samples, db_factor(peak_target) / peak(samples))).otherwise(same)
    if mode == "rms":
        level = active_rms(samples, frame)
        return F.when(level > 0, scaled(samples, db_factor(rms_target) / level)).otherwise(same)
    return scaled(samples, db_factor(float(mode)))


def clipped_share(samples: Column, limit: float = 0.999) -> Column:
    return F.size(F.filter(samples, lambda v: F.abs(v.cast("double")) >= limit)) / F.nullif(F.size(samples), F.lit(0))


def largest_gap(a: Column, b: Column) -> Column:
    """Largest absolute difference of two aligned vectors (agreement check)."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
