"""Timed tokens to cues, and cues to subtitle documents.

``sessions`` is the plain gap split, all windows.  ``build`` is the full rule, whose state
(text so far, start, last time) runs through a file's tokens in order: one group a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skriva.functions import text
from skriva.operators.chunking import map_time

TOKEN_S = 0.08
#: Characters that end a sentence.
SENTENCE_ENDS = "。！？?!"


@dataclass(frozen=True)
class Layout:
    gap_s: float = 1.2
    max_chars: int = 28
    max_dur_s: float = 7.0

    def __post_init__(self) -> None:
        if self.gap_s <= 0 or self.max_chars < 1 or self.max_dur_s <= 0:
            raise ValueError(f"a cue needs room: {self}")


def events(tokens: DataFrame, chunks: DataFrame, n_special: int = 0, special: Iterable[int] = ()) -> DataFrame:
    """Tokens on the file's time line, special ones left out: chunk times plus the chunk's offset."""
    keep = (F.col("token_id") >= n_special) & ~F.col("token_id").isin(list(special)) if (special := list(special)) else F.col("token_id") >= n_special
    return tokens.where(keep).join(chunks.select("file_id", "chunk_idx", "offset_s"), ["file_id", "chunk_idx"]).withColumn("t_s", F.col("t_s") + F.col("offset_s")).drop("offset_s")


class Builder:
    """The cue rule as a machine: feed (bytes, time) in order, take finished cues."""

    def __init__(self, layout: Layout = Layout(), state: tuple[bytes, float | None, float | None] = (b"", None, None)) -> None:
        self.layout = layout
        self.held, self.start, self.last = state

    def _whole(self) -> str | None:
        """The text held, if it ends on a character boundary."""
        try:
            return self.held.decode()
        except UnicodeDecodeError:
            return None

    def flush(self) -> list[tuple[float, float, str]]:
        said = self.held.decode(errors="replace").strip()
        out = [(self.start, self.last, said)] if said else []
        self.held, self.start, self.last = b"", None, None
        return out

    def feed(self, piece: bytes, t: float) -> list[tuple[float, float, str]]:
        out: list[tuple[float, float, str]] = []
        at, held = self.layout, self._whole() if self.start is not None else None
        if held is not None and (t - self.last > at.gap_s or len(held) >= at.max_chars or t - self.start > at.max_dur_s):
            out += self.flush()
        if self.start is None:
            self.start = max(t - TOKEN_S, 0.0)
        self.held, self.last = self.held + piece, t
        now = self._whole()
        if now and len(now) >= at.max_chars // 2 and now[-1] in SENTENCE_ENDS:
            out += self.flush()
        return out


def cues_of(pieces: Iterable[tuple[bytes, float]], layout: Layout = Layout()) -> Iterator[tuple[float, float, str]]:
    b = Builder(layout)
    for piece, t in pieces:
        yield from b.feed(bytes(piece), float(t))
    if b.held:
        yield from b.flush()


def build(tokens: DataFrame, layout: Layout = Layout(), by: str = "file_id", order: tuple[str, ...] = ("chunk_idx", "pos"), piece: str = "bytes", at: str = "t_s", time_map: DataFrame | None = None) -> DataFrame:
    """(by, cue_idx, start_s, end_s, text) of every file.

    Tokens stream by in order, file after file; no file is held as a whole.  ``time_map``
    (by, new_start_s, old_start_s) brings the cues of compacted audio back to the original times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, machine, n = [by, "cue_idx", "start_s", "end_s", "text"], None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for file, raw, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if machine is None or file != key:
                    if machine is not None and machine.held:
                        rows += [(key, n + k, *c) for k, c in enumerate(machine.flush())]
                    key, machine, n = file, Builder(layout), 0
                for c in machine.feed(bytes(raw), float(t)):
                    rows.append((key, n, *c))
                    n += 1
            yield _rows(rows, names, batch.column(0).type)
        if machine is not None and machine.held:
            yield _rows([(key, n + k, *c) for k, c in enumerate(machine.flush())], names, batch.column(0).type)

    kind = tokens.schema[by].dataType.simpleString()
    lined = tokens.select(by, piece, F.col(at).cast("double"), *order).repartition(by).sortWithinPartitions(by, *order)
    cues = lined.select(by, piece, at).mapInArrow(run, f"{by} {kind}, cue_idx int, start_s double, end_s double, text string")
    return cues if time_map is None else remapped(cues, time_map, by)


def remapped(cues: DataFrame, time_map: DataFrame, by: str = "file_id") -> DataFrame:
    """``cues`` with their times by a map (by, new_start_s, old_start_s); files without one keep theirs."""
    for c in ("start_s", "end_s"):
        cues = map_time(cues, time_map, by, c, "_old").withColumn(c, F.col("_old")).drop("_old")
    return cues


def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.float64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def sessions(rows: DataFrame, by: str, at: str, gap_s: float = 1.2) -> DataFrame:
    """``rows`` with cue_idx: a new one where the gap is larger than ``gap_s``."""
    line = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(line) > gap_s, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cue_idx", F.sum("_new").over(line.rangeBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


# -- documents


def _block(sep: str, width: int, min_dur: float, number: Column) -> Column:
    end = F.greatest(F.col("end_s"), F.col("start_s") + min_dur)
    return F.concat(number.cast("string"), F.lit("\n"), text.timestamp(F.col("start_s"), sep), F.lit(" --> "), text.timestamp(end, sep), F.lit("\n"), text.wrap(F.col("text"), width), F.lit("\n\n"))


def _joined(cues: DataFrame, by: str, part: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", part.alias("p")))), lambda s: s["p"]), sep)


def srt(cues: DataFrame, by: str = "file_id", width: int = 16, min_dur: float = 0.5) -> DataFrame:
    return cues.groupBy(by).agg(_joined(cues, by, _block(",", width, min_dur, F.col("cue_idx") + 1)).alias("document"))


def vtt(cues: DataFrame, by: str = "file_id", width: int = 16, min_dur: float = 0.5) -> DataFrame:
    return cues.groupBy(by).agg(F.concat(F.lit("WEBVTT\n\n"), _joined(cues, by, _block(".", width, min_dur, F.col("cue_idx") + 1))).alias("document"))


def txt(cues: DataFrame, by: str = "file_id") -> DataFrame:
    return cues.groupBy(by).agg(F.concat(_joined(cues, by, F.col("text"), "\n"), F.lit("\n")).alias("document"))


def json_document(cues: DataFrame, by: str = "file_id", full_text: DataFrame | None = None) -> DataFrame:
    """Text and segments (times to 3 places); ``full_text`` (by, full_text) replaces the joined cue texts."""
    segment = F.struct(F.col("cue_idx").cast("int").alias("id"), F.bround("start_s", 3).alias("start"), F.bround("end_s", 3).alias("end"), F.col("text"))
    rows = cues.groupBy(by).agg(_joined(cues, by, F.col("text")).alias("text"), F.array_sort(F.collect_list(segment)).alias("segments"))
    if full_text is not None:
        rows = rows.join(full_text, by, "left").withColumn("text", F.coalesce("full_text", "text"))
    return rows.select(by, F.to_json(F.struct("text", "segments")).alias("document"))


DOCUMENTS = {"srt": srt, "vtt": vtt, "txt": txt, "json": json_document}


def check_format(fmt: str, speech_times: bool = True) -> str:
    """An output format, or an error before any job runs: no subtitles without speech times."""
    if fmt != "all" and fmt not in DOCUMENTS:
        raise ValueError(f"unknown format {fmt!r}: one of {', '.join(DOCUMENTS)} or all")
    if not speech_times and fmt in ("srt", "vtt", "all"):
        raise ValueError(f"this engine has no speech times, so {fmt!r} would be made up; use txt or json")
    return fmt


def end_clamp(start: Column, end: Column, least: float = 0.05) -> Column:
    return F.greatest(end, start + least)


def chunk_texts(tokens: DataFrame, by: str = "file_id", piece: str = "bytes") -> DataFrame:
    """(by, chunk_idx, text): a chunk's bytes are put together before they are decoded; what is no character becomes U+FFFD."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex(piece).alias("h")))), lambda s: s["h"])
    return tokens.groupBy(by, "chunk_idx").agg(F.make_valid_utf8(F.unhex(F.array_join(parts, "")).cast("string")).alias("text"))


def transcript(chunks: DataFrame, by: str = "file_id", sep: str = "") -> DataFrame:
    """(by, full_text): chunk texts in order, empty ones left out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda s: s["text"])
    return chunks.where("text <> ''").groupBy(by).agg(F.array_join(parts, sep).alias("full_text"))
