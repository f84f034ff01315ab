"""How well hypothesis times agree with a reference: character timelines, anchors, drift, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriva.functions import text
from skriva.operators import align, scan
from skriva.operators.joins import asof, band, greedy


def timeline(cues: DataFrame, by: str = "file_id", normal: bool = True) -> DataFrame:
    """(by, char_pos, ch, t_s): each character of a cue at its share of the cue's time; empty cues have none."""
    said = text.normalize_chars(F.col("text")) if normal else text.drop_marks(F.col("text"))
    line = cues.select(by, "cue_idx", "start_s", "end_s", text.characters(said).alias("line"))
    line = scan.sum_before(line.withColumn("n", F.size("line")), [by], ["cue_idx"], F.col("n").cast("bigint"), "_before_cue")  # once a cue, not once a character
    rows = line.select(by, "_before_cue", "start_s", "end_s", "n", F.posexplode("line").alias("i", "ch"))
    at = F.col("start_s") + F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-6)) * (F.col("i") + 0.5) / F.col("n")
    return rows.select(by, (F.col("_before_cue") + F.col("i")).alias("char_pos"), "ch", at.alias("t_s"))


def anchors(ops: Column, min_anchor: int = 8, max_span: int = 40) -> Column:
    """Matched runs of ``min_anchor`` or more units as (ref_pos, hyp_pos, len), long ones in pieces, the last with the rest."""
    n = lambda o: o["s1"] - o["s0"]
    pieces = lambda o: F.when(n(o) > max_span, F.floor(n(o) / max_span).cast("int")).otherwise(F.lit(1))

    def split(o: Column) -> Column:
        step = F.floor(n(o) / pieces(o)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), pieces(o) - 1),
            lambda k: F.struct((o["s0"] + k * step).alias("ref_pos"), (o["d0"] + k * step).alias("hyp_pos"), F.when(k < pieces(o) - 1, step).otherwise(n(o) - step * (pieces(o) - 1)).alias("len")),
        )

    return F.flatten(F.transform(F.filter(ops, lambda o: (o["tag"] == "equal") & (n(o) >= min_anchor)), split))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the half-even rounded rank; not interpolated."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.try_element_at(s, (F.bround(F.lit(q / 100.0) * (F.size(s) - 1)).cast("int") + 1)))


def slope(y: Column, x: Column) -> Column:
    """Least squares; null under three points or without spread."""
    return F.when((F.regr_count(y, x) >= 3) & (F.regr_sxx(y, x) >= 1e-9), F.regr_slope(y, x))


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def drift(errors: DataFrame, by: str, error_ms: str = "error_ms", at_min: str = "at_min") -> DataFrame:
    """Statistics of signed anchor errors by file."""
    return errors.groupBy(by).agg(F.count("*").alias("anchors"), *_drift(error_ms, at_min))


def _drift(error_ms: str, at_min: str) -> list[Column]:
    size = F.abs(F.col(error_ms))
    return [
        F.median(size).alias("median_abs_ms"), nearest_rank(F.collect_list(size), 95).alias("p95_abs_ms"), F.max(size).alias("max_abs_ms"),
        F.median(error_ms).alias("constant_offset_ms"), slope(F.col(error_ms), F.col(at_min)).alias("drift_slope_ms_per_min"), (F.max(at_min) - F.min(at_min)).alias("span_min"),
    ]


def anchor_errors(ref: DataFrame, hyp: DataFrame, by: str = "file_id", min_anchor: int = 8, max_span: int = 40) -> DataFrame:
    """(by, error_ms, at_min, len, ref_chars) at the middle of every anchor."""
    return _anchored(ref, hyp, by, min_anchor, max_span).where("len is not null")


def _anchored(ref: DataFrame, hyp: DataFrame, by: str, min_anchor: int, max_span: int) -> DataFrame:
    """``anchor_errors``, and one row of nulls for a file of both sides without anchors.

    What moves is one row a cue; characters get their times only where an anchor asks.
    """
    before = Window.partitionBy(by).orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)

    def whole(cues: DataFrame, side: str) -> DataFrame:
        said = cues.select(by, "cue_idx", "start_s", "end_s", F.coalesce(text.normalize_chars(F.col("text")), F.lit("")).alias("said")).withColumn("n", F.length("said"))
        said = said.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return said.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("cue_idx", "first", "n", "start_s", "end_s", "said"))).alias(side))

    both = whole(ref, "r").join(whole(hyp, "h"), by)
    own = lambda side: F.flatten(F.transform(side, lambda c, k: F.array_repeat(k + 1, c["n"])))  # noqa: E731  the cue of each character
    line = lambda side: F.array_join(F.transform(side, lambda c: c["said"]), "")
    rows = both.select(by, "r", "h", own("r").alias("in_r"), own("h").alias("in_h"), line("r").alias("ref"), align.edit_script(line("r"), line("h")).alias("ops"))
    rows = rows.select(by, "r", "h", "in_r", "in_h", F.length("ref").alias("ref_chars"), F.explode_outer(anchors(F.col("ops"), min_anchor, max_span)).alias("a"))

    def at(side: str, pos: Column) -> Column:
        cue = F.try_element_at(F.col(side), F.try_element_at(F.col(f"in_{side}"), (pos + 1).cast("int")))
        return cue["start_s"] + F.greatest(cue["end_s"] - cue["start_s"], F.lit(1e-6)) * ((pos - cue["first"]) + 0.5) / cue["n"]

    mid = F.floor(F.col("a.len") / 2).cast("int")
    timed = rows.select(by, at("r", F.col("a.ref_pos") + mid).alias("rt"), at("h", F.col("a.hyp_pos") + mid).alias("ht"), F.col("a.len").alias("len"), "ref_chars")
    return timed.select(by, ((F.col("ht") - F.col("rt")) * 1000.0).alias("error_ms"), (F.col("rt") / 60.0).alias("at_min"), "len", "ref_chars")


def drift_stats(ref: DataFrame, hyp: DataFrame, by: str = "file_id", min_anchor: int = 8, max_span: int = 40) -> DataFrame:
    """``drift`` and anchor_coverage of every file that both sides have; without anchors the count is 0."""
    covered = F.coalesce(F.sum("len") / F.greatest(F.max("ref_chars"), F.lit(1)), F.lit(0.0))
    return _anchored(ref, hyp, by, min_anchor, max_span).groupBy(by).agg(F.count("len").alias("anchors"), *_drift("error_ms", "at_min"), covered.alias("anchor_coverage"))


def mid_phrase(ref: DataFrame, hyp_ends: DataFrame, by: str, end: str = "h", tol: float = 0.5) -> DataFrame:
    """``hyp_ends`` that fall inside a reference cue, away from its edges: splits the author did not make."""
    held = asof(hyp_ends, ref.select(by, "start_s", "end_s"), end, "start_s", [by], ["start_s", "end_s"])
    return held.where((F.col("start_s") + tol < F.col(end)) & (F.col(end) < F.col("end_s") - tol))


def break_stats(ref: DataFrame, hyp: DataFrame, by: str = "file_id", tol: float = 0.5) -> DataFrame:
    """Boundary precision, recall and F1, and the share of cue ends inside reference cues."""
    r, h = ref.select(by, F.col("end_s").alias("r")), hyp.select(by, F.col("end_s").alias("h"))
    hits = greedy(band(h, r, "h", "r", tol, [by]), by, "h", "r").groupBy(by).agg(F.count("*").alias("tp"))
    inside = mid_phrase(ref, h, by, "h", tol).groupBy(by).agg(F.count("*").alias("mid"))
    side = lambda cues, name: cues.groupBy(by).agg(F.count("*").alias(f"{name}_cues"), F.median(F.col("end_s") - F.col("start_s")).alias(f"{name}_median_dur_s"))
    rows = side(ref, "ref").join(side(hyp, "hyp"), by).join(hits, by, "left").join(inside, by, "left").fillna(0, ["tp", "mid"])
    p, q = F.col("tp") / F.col("hyp_cues"), F.col("tp") / F.col("ref_cues")
    return rows.select(
        by, "ref_cues", "hyp_cues", "tp", p.alias("boundary_precision"), q.alias("boundary_recall"), F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0).alias("break_f1"),
        (F.col("mid") / F.col("hyp_cues")).alias("mid_phrase_rate"), "ref_median_dur_s", "hyp_median_dur_s",
    )


def seam_zones(edits: DataFrame, seams: DataFrame, by: str, at: str = "t_s", seam: str = "seam_s", near_s: float = 3.0) -> DataFrame:
    """``edits`` with zone: after a seam (tested first), before one, or elsewhere."""
    behind = asof(edits, seams, at, seam, [by], [seam]).withColumnRenamed(seam, "_behind")
    flipped = asof(behind.withColumn("_neg", -F.col(at)), seams.withColumn("_ns", -F.col(seam)), "_neg", "_ns", [by], [seam]).withColumnRenamed(seam, "_ahead")
    zone = F.when(F.col(at) - F.col("_behind") < near_s, "after").when(F.col("_ahead") - F.col(at) < near_s, "before").otherwise("elsewhere")
    return flipped.withColumn("zone", zone).drop("_behind", "_ahead", "_neg")
